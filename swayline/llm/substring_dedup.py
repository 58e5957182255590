"""Substring dedup over words: winnowed anchors as seeds, extended both ways to maximal repeats.

A word is a run of characters other than ASCII white space. Seeds (``seeds.py``) bring together all
places of an anchor that stands in two documents. A match is extended from the anchor one word at a
time to either side for all its places at once: a step holds where the ``min_words`` words around the
anchor, so moved, also stand in a smaller document (compared by 64-bit hashes within one anchor).
The steps that hold make the maximal repeats of at least ``min_words`` words; each document loses
the words that a smaller document has in such a repeat.

Defined results: a missing text has no words; a missing id takes part in nothing and comes back
whole; repeated rows of one id are judged by their id, so copies within one id stay; other columns do
not take part.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swayline.llm import rolling, seeds

RESULT = pa.schema([
    ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def _windows(symbols, sums, first, n, shape):
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return rolling.span_hashes(sums, at, at + shape.window), n, rolling.span_hashes(sums, first, first + n + shape.window - 1)


def extend(keys, docs, starts, n, sizes, hashes, shape):
    """Spans of words that a smaller document has too: runs of extension steps that hold."""
    place = np.repeat(np.arange(len(keys)), n)
    step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    doc = docs[place]
    order = np.lexsort((doc, hashes))
    first = seeds._first_of(hashes[order])
    least = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
    holds = np.zeros(len(place), bool)
    holds[order] = doc[order] > least
    at = np.flatnonzero(holds)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (place[at[1:]] != place[at[:-1]])))) if len(at) else at
    head, tail = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
    start = starts[place[head]] + step[head]
    return docs[place[head]], start, start + (tail - head) + shape.window


def _kept(text, start, end):
    words = text.split()
    n = len(words)
    if len(start):
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, start, 1)
        np.add.at(gone, end, -1)
        words = list(itertools.compress(words, (np.cumsum(gone[:n]) == 0).tolist()))
    return {"n_words": n, "n_removed": n - len(words), "kept": b" ".join(words).decode(), "spans": [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())]}


def substring_dedup(docs, min_words=50, gram=8, id_col="doc_id", text_col="text"):
    """One row per document: id, n_words, n_removed, kept (words joined by a space), spans (word ranges cut out)."""
    shape = seeds.Shape(True, min_words, gram)
    spans, blocks, _ = seeds.repeat_spans(seeds.with_id(docs, id_col, text_col), shape, _windows, extend)
    return seeds.with_missing(docs, seeds.cut(blocks, spans, _kept, RESULT), _kept, RESULT, id_col, text_col)


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
