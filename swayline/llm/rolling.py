"""Vectorised rolling hashes and window minima over numpy arrays, used inside tasks.

A batch of documents is laid out as one array of symbols (bytes, or one 64-bit number per word).
``gram_hashes`` gives a 64-bit hash of every run of ``k`` symbols, ``owners`` the position of the
smallest hash in every window: the winnowed anchor of that window. Equal windows have equal anchors
at equal distances, wherever they stand.
"""

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Positions of a batch take the low bits of an order key, so a batch holds fewer symbols than this.
POSITION_BITS = 24
MAX_BATCH = 1 << POSITION_BITS


@lru_cache(maxsize=2)
def _powers(base, n):
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_table(base, n):
    size = 1 << 16
    while size < n:
        size <<= 1
    return _powers(int(base), size)[:n]


def mix(h):
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix(symbols):
    """Prefix sums of ``symbol * BASE**i``; one entry more than symbols."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, len(symbols)), out=out[1:])
    return out


def span_hashes(sums, starts, ends):
    """Hash of symbols ``[start, end)``; depends on the symbols and their number only."""
    return mix((sums[ends] - sums[starts]) * _power_table(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(sums, k):
    """Hash of each run of ``k`` symbols; empty when there are fewer."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * _power_table(INVERSE, n) + np.uint64(k))


def owners(grams, w):
    """For each window of ``w`` consecutive grams, the position of its smallest (first, if tied)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keys = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    if size < w:
        keys = np.minimum(keys[:n], keys[w - size : w - size + n])
    return (keys & np.uint64(MAX_BATCH - 1)).astype(np.int64)


def runs(owner, valid):
    """Runs of consecutive valid windows with one owner: (first window, number of windows, owner)."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, at
    own = owner[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(at) != 1))))
    return at[first], np.diff(np.append(first, len(at))), own[first]
