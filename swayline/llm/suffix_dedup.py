"""Suffix-array dedup over bytes: interval tree of an enhanced suffix array, in balanced buckets.

Buckets come from ``seeds.py``: all windows of ``min_bytes`` bytes that share a seed are together, so
every repeat of that length can be seen inside one bucket. A bucket sorts the suffixes of the
surroundings of its seeds (equal surroundings once), scans the common prefixes of neighbours with a
stack into an interval tree, and keeps the intervals of at least ``min_bytes`` whose occurrences differ
on their left (or start at the edge of what the bucket sees): the maximal repeat groups, each with all
its occurrences. Every occurrence outside the smallest document of its group is cut out.

A group reaches as far as the bucket sees: a longer repeat comes as a chain of overlapping groups, and
the spans of a document join them again.

Defined results: a missing text is empty; a missing id takes part in nothing and comes back whole;
repeats within one id stay; other columns come through in ``rest`` if asked for, whatever their names. Text that is cut
inside a character is decoded with replacement characters for the text column; digests use the bytes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swayline.llm import rolling, seeds
from swayline.llm.common import rows_of, sha256

RESULT = pa.schema([
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()),
    ("kept_sha256", pa.string()),
])
#: Suffixes that are sorted at a time; a seed's suffixes are never parted.
SORT_ROWS = 50_000


def _surroundings(symbols, sums, first, n, shape):
    size = n + shape.window - 1
    return seeds.take(symbols, first, size), size, rolling.span_hashes(sums, first, first + size)


def suffix_array(body, offset, size, n, width):
    """Suffixes ``j < n`` of each text, sorted: (text number, j, common prefix with the suffix before)."""
    text = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    left = size[text] - j
    table = np.zeros((len(text), width), np.uint8)
    for column in range(int(left.max(initial=0))):  # column by column: rows that have ended stay zero
        rows = slice(None) if column < left.min() else left > column
        table[rows, column] = body[(offset[text] + j + column)[rows]]
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    table, text, j, left = table[order], text[order], j[order], left[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.concatenate(([0], np.minimum(common, np.minimum(left[1:], left[:-1])))) if len(text) else left
    return text, j, common


def intervals(common, least, doc):
    """Nodes of the interval tree of at least ``least``: arrays (first, last, length, smallest document).

    One scan with a stack; ``common[i]`` is the prefix that suffix ``i`` shares with ``i - 1``.
    """
    nodes = []
    inner = np.flatnonzero(common >= least)
    if not len(inner):
        return np.zeros((0, 4), np.int64)
    breaks = np.flatnonzero(np.diff(inner) != 1)
    runs = zip(inner[np.concatenate(([0], breaks + 1))].tolist(), inner[np.concatenate((breaks, [len(inner) - 1]))].tolist())
    for lo, hi in runs:
        depth, low = common[lo : hi + 1], doc[lo - 1 : hi + 1]
        if depth[0] == depth[-1] and (depth == depth[0]).all():
            nodes.append((lo - 1, hi, int(depth[0]), int(low.min())))
            continue
        low = low.tolist()
        stack = []  # (length, first, smallest document)
        for i, length in enumerate(depth.tolist(), lo):
            first, smallest = i - 1, low[i - lo]
            while stack and stack[-1][0] >= length:
                top, begun, small = stack.pop()
                smallest = min(smallest, small)
                first = begun
                if top > length:
                    nodes.append((begun, i - 1, top, smallest))
                    continue
                break
            stack.append((length, first, smallest))
        smallest = low[-1]
        while stack:
            top, begun, small = stack.pop()
            smallest = min(smallest, small)
            nodes.append((begun, hi, top, smallest))
    return np.array(nodes, np.int64).reshape(-1, 4)


def groups(keys, docs, starts, n, sizes, body, shape):
    """Maximal repeat groups of a bucket.

    Returns the occurrences' texts (number of its distinct surroundings for each entry), the entries'
    order and arrays of nodes with their suffixes, for ``covered`` and ``repeat_groups``.
    """
    offset = np.cumsum(sizes.astype(np.int64)) - sizes
    sums = rolling.prefix(body)
    prints = rolling.span_hashes(sums, offset, offset + sizes)
    order = np.lexsort((docs, prints, keys))
    mixed = prints[order] ^ rolling.mix(keys[order])
    first = seeds._first_of(mixed)
    kind = np.empty(len(keys), np.int64)  # the distinct surroundings that an entry has
    kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    one = order[first]  # their entry with the smallest document
    return offset, kind, one


def tree_nodes(keys, docs, n, sizes, body, offset, one, shape):
    """Left-diverse nodes over the distinct surroundings ``one``: (surroundings, j, length, smallest document, node)."""
    key = keys[one]
    start = seeds._first_of(key)
    count = np.diff(np.append(start, len(key)))
    alone = np.repeat(count == 1, count)
    out = [(np.flatnonzero(alone), np.zeros(alone.sum(), np.int64), sizes[one][alone].astype(np.int64), docs[one][alone], np.arange(alone.sum()))]
    node_at = int(alone.sum())
    many = np.flatnonzero(~alone)
    if len(many):
        heavy = np.cumsum(n[one][many].astype(np.int64))
        ends = np.flatnonzero(np.append(key[many][1:] != key[many][:-1], True))
        part = heavy[ends] // SORT_ROWS
        bounds = np.concatenate(([0], ends[np.append(part[1:] != part[:-1], True)] + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            mine = many[a:b]
            entry = one[mine]
            text, j, common = suffix_array(body, offset[entry], sizes[entry].astype(np.int64), n[entry].astype(np.int64), 8 * -(-(2 * shape.window - shape.gram) // 8))
            doc = docs[entry][text]
            nodes = intervals(common, shape.window, doc)
            if not len(nodes):
                continue
            edge = np.concatenate(([0], np.cumsum(j == 0)))
            before = np.where(j > 0, body[offset[entry][text] + np.maximum(j, 1) - 1], 0)
            change = np.concatenate(([0, 0], np.cumsum(before[1:] != before[:-1])))
            lo, hi = nodes[:, 0], nodes[:, 1]
            diverse = (edge[hi + 1] > edge[lo]) | (change[hi + 1] > change[lo + 1])
            nodes = nodes[diverse]
            size = nodes[:, 1] - nodes[:, 0] + 1
            at = np.repeat(nodes[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append((mine[text[at]], j[at], np.repeat(nodes[:, 2], size), np.repeat(nodes[:, 3], size), node_at + np.repeat(np.arange(len(nodes)), size)))
            node_at += len(nodes)
    return tuple(np.concatenate(x) for x in zip(*out))


def cover(keys, docs, starts, n, sizes, body, shape):
    """Spans of bytes that a smaller document has too; a bucket is judged in parts of whole seeds, to bound memory."""
    order = np.argsort(keys, kind="stable")
    offset = np.cumsum(sizes) - sizes
    last = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True))
    part = np.cumsum(n[order])[last] // SORT_ROWS
    ends = last[np.append(part[1:] != part[:-1], True)] + 1
    spans = []
    for a, b in zip([0, *ends[:-1]], ends):
        rows = order[a:b]
        spans.append(_cover(keys[rows], docs[rows], starts[rows], n[rows], sizes[rows], seeds.take(body, offset[rows], sizes[rows]), shape))
    return tuple(np.concatenate(x) for x in zip(*spans))


def _cover(keys, docs, starts, n, sizes, body, shape):
    """Spans of one part, from its maximal repeat groups."""
    offset, kind, one = groups(keys, docs, starts, n, sizes, body, shape)
    which, j, length, smallest, _ = tree_nodes(keys, docs, n, sizes, body, offset, one, shape)
    # within its own surroundings all but the smallest document's entries are covered whole
    more = docs > docs[one][kind]
    spans = [(docs[more], starts[more].astype(np.int64), starts[more] + sizes[more])]
    # of the smallest document's entries, what a node's smaller document covers
    hit = docs[one][which] > smallest
    which, j, length = which[hit], j[hit], length[hit]
    order = np.argsort(which, kind="stable")
    which, j, length = which[order], j[order], length[order]
    rest = np.flatnonzero(~more)
    lo, hi = np.searchsorted(which, kind[rest], "left"), np.searchsorted(which, kind[rest], "right")
    size = hi - lo
    at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    entry = np.repeat(rest, size)
    spans.append((docs[entry], starts[entry] + j[at], starts[entry] + j[at] + length[at]))
    return tuple(np.concatenate(x) for x in zip(*spans))


def _kept(text, start, end):
    left, at = [], 0
    for a, b in zip(start.tolist(), end.tolist()):
        left.append(text[at:a])
        at = b
    left.append(text[at:])
    kept = b"".join(left)
    return {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(start), "kept": kept.decode(errors="replace"), "kept_sha256": sha256(kept)}


def suffix_dedup(docs, min_bytes=50, gram=24, id_col="doc_id", text_col="text", carry=()):
    """Rows of ``docs`` as (id, n_bytes, n_removed, n_spans, kept, kept_sha256), with the columns ``carry`` in ``rest``."""
    shape = seeds.Shape(False, min_bytes, gram)
    spans, blocks, _ = seeds.repeat_spans(seeds.with_id(docs, id_col, text_col, carry), shape, _surroundings, cover)
    return seeds.with_missing(docs, seeds.cut(blocks, spans, _kept, RESULT), _kept, RESULT, id_col, text_col, carry)


GROUP = pa.schema([("group_key", pa.binary()), ("length", pa.int64()), ("id", pa.int64()), ("start", pa.int64())])


def repeat_groups(docs, min_bytes=50, gram=24, id_col="doc_id", text_col="text"):
    """All maximal repeat groups: one row per occurrence (group_key, length, id, start); a group has one key."""
    shape = seeds.Shape(False, min_bytes, gram)

    def listed(keys, owner, starts, n, sizes, body, _):
        offset, kind, one = groups(keys, owner, starts, n, sizes, body, shape)
        which, j, length, _, node = tree_nodes(keys, owner, n, sizes, body, offset, one, shape)
        sums = rolling.prefix(body)
        order = np.argsort(kind, kind="stable")
        lo, hi = np.searchsorted(kind[order], which, "left"), np.searchsorted(kind[order], which, "right")
        size = hi - lo
        at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        entry = order[at]
        j, length = np.repeat(j, size), np.repeat(length, size)
        begin = offset[entry] + j
        key = rolling.span_hashes(sums, begin, begin + length)
        return [(int(k).to_bytes(8, "big"), int(x), int(d), int(s)) for k, x, d, s in zip(key, length, owner[entry], starts[entry] + j)]

    return seeds.repeat_rows(seeds.with_id(docs, id_col, text_col), shape, _surroundings, lambda *a: rows_of(listed(*a), GROUP), GROUP, "group_key binary, length long, id long, start long")


def op3_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
