"""Reproducible random draws: every draw depends only on its own key, not on row order or task."""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Trials that one uniform decides: few enough that the chance of no success never vanishes.
TRIALS = 64


def uniform(*key):
    """Uniform in (0, 1) from a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def standard_normal(*key):
    """Normal draw from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.log(uniform(*key, F.lit("radius"))) * -2)
    return radius * F.cos(uniform(*key, F.lit("angle")) * F.lit(2 * math.pi))


def _turned(h, bits):
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def hashed_on(seeds, values):
    """What ``F.xxhash64`` makes of one more column: ``seeds`` is its value without it, ``values`` 32-bit integers or doubles."""
    one, two, three, four, five = (np.uint64(k) for k in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    if values.dtype == np.int32:
        h = (seeds + (five + np.uint64(4))) ^ (values.view(np.uint32).astype(np.uint64) * one)
        h = _turned(h, 23) * two + three
    else:
        bits = (values + 0.0).view(np.uint64)  # without negative zeros
        h = (seeds + (five + np.uint64(8))) ^ (_turned(bits * two, 31) * one)
        h = _turned(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def hashed_uniform(key, part):
    """Uniforms in (0, 1) from 64-bit keys and the number of a part."""
    h = key.astype(np.uint64) + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def inverted(trials, p, u):
    """Binomial quantiles at ``u`` for at most ``TRIALS`` trials, all side by side."""
    rare = np.minimum(p, 1 - p)
    ratio = rare / (1 - rare)
    mass = (1 - rare) ** trials
    left, count = u - mass, np.zeros(len(u), np.int64)
    open_, k = np.flatnonzero(left > 0), 0
    n, ratio, mass, left = trials[open_], ratio[open_], mass[open_], left[open_]
    while len(open_) and k < TRIALS:
        k += 1
        mass *= np.maximum(n - k + 1, 0) / k * ratio
        count[open_] += k <= n
        left -= mass
        still = np.flatnonzero((left > 0) & (k < n))
        if len(still) < len(n):
            open_, n, ratio, mass, left = open_[still], n[still], ratio[still], mass[still], left[still]
    return np.where(p > 0.5, trials - count, count)


def drawn(trials, p, key):
    """Binomial draws by inversion of uniforms hashed from the 64-bit key, one for each ``TRIALS`` trials."""
    n = trials.astype(np.int64)
    if n.max(initial=0) <= TRIALS:  # a uniform each
        return inverted(n, p, hashed_uniform(key.view(np.uint64), np.zeros(1, np.int64))).astype(np.float64)
    parts = -(-n // TRIALS)
    row = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(TRIALS, n[row] - part * TRIALS)
    return np.bincount(row, inverted(size, p[row], hashed_uniform(key[row].view(np.uint64), part)), len(n))


@F.pandas_udf(DoubleType())
def binomial(trials: pd.Series, p: pd.Series, key: pd.Series) -> pd.Series:
    """``drawn`` as a column."""
    return pd.Series(drawn(trials.to_numpy(), p.to_numpy(), key.to_numpy()))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
