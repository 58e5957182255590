"""Substring and suffix-array dedup against brute force."""

import hashlib
import re

import pytest
from fixtures import SCHEMA, tricky_docs

from swayline.llm import rolling, seeds
from swayline.llm.substring_dedup import substring_dedup
from swayline.llm.suffix_dedup import repeat_groups, suffix_dedup


def covered(sequences, window):
    """Per (id, symbols) the symbols covered by a window that also starts in a smaller document."""
    least = {}
    for i, s in sequences:
        if i is not None:
            for p in range(len(s) - window + 1):
                w = s[p : p + window]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, s in sequences:
        gone = [False] * len(s)
        if i is not None:
            for p in range(len(s) - window + 1):
                if least[s[p : p + window]] < i:
                    gone[p : p + window] = [True] * window
        out.append((i, s, gone))
    return out


def expected_words(rows, window):
    parsed = [(r[0], tuple(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    return sorted(((i, len(s), sum(g), " ".join(w for w, x in zip(s, g) if not x)) for i, s, g in covered(parsed, window)), key=str)


def expected_bytes(rows, window):
    out = []
    for i, s, g in covered([(r[0], (r[1] or "").encode()) for r in rows], window):
        kept = bytes(b for b, x in zip(s, g) if not x)
        runs = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        out.append((i, len(s), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def word_rows(spark, rows, window=50, gram=8):
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA), window, gram).collect()
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in out), key=str)


def byte_rows(spark, rows, window=50, gram=24):
    out = suffix_dedup(spark.createDataFrame(rows, SCHEMA), window, gram).collect()
    return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)


@pytest.mark.parametrize("seed,window,gram", [(3, 50, 8), (4, 20, 5)])
def test_words_against_brute_force(spark, seed, window, gram):
    rows = tricky_docs(seed)
    assert word_rows(spark, rows, window, gram) == expected_words(rows, window)


@pytest.mark.parametrize("seed,window,gram", [(5, 50, 24), (6, 30, 12)])
def test_bytes_against_brute_force(spark, seed, window, gram):
    rows = tricky_docs(seed)
    assert byte_rows(spark, rows, window, gram) == expected_bytes(rows, window)


def test_hot_seeds_and_small_chunks(spark, monkeypatch):
    rows = tricky_docs(7)
    monkeypatch.setattr(seeds, "HOT_LEAST", 3)
    assert word_rows(spark, rows) == expected_words(rows, 50)
    assert byte_rows(spark, rows) == expected_bytes(rows, 50)


def test_long_documents_are_cut_into_overlapping_chunks():
    import numpy as np

    old, seeds.CHUNK = seeds.CHUNK, 40
    try:
        text = bytes(np.random.default_rng(1).integers(97, 100, 900, dtype=np.uint8))
        data = np.frombuffer(text, np.uint8)
        shape = seeds.Shape(False, 20, 8)
        found = []
        for symbols, doc, at, left in seeds.symbol_chunks(data, np.array([0, 700]), np.array([700, 900]), shape):
            _, first, n, seed = seeds.occurrences(symbols, doc, at, left, shape)
            found += [(int(doc[f]), int(at[f]) + k) for f, m in zip(first, n) for k in range(m)]
        assert sorted(found) == [(d, p) for d, size in ((0, 700), (1, 200)) for p in range(size - 19)]
    finally:
        seeds.CHUNK = old


def test_groups_are_maximal_and_whole(spark):
    texts = {1: "xx" + "abcdefghij" * 2 + "KLM" + "q1", 2: "yy" + "abcdefghij" * 2 + "KLM" + "r2", 3: "zz" + "abcdefghij" * 2 + "s3"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    found = {}
    for r in repeat_groups(docs, 20, 10).collect():
        found.setdefault((bytes(r.group_key), r.length), set()).add((r.id, r.start))
    strings = {texts[min(v)[0]][min(v)[1] : min(v)[1] + k[1]]: v for k, v in found.items()}
    whole = "abcdefghij" * 2
    assert strings[whole] == {(1, 2), (2, 2), (3, 2)}
    assert all(v == {(i, p) for i, t in texts.items() for p in range(len(t)) if t.startswith(s, p)} for s, v in strings.items())
    assert set().union(*({(1, p + k) for k in range(len(s))} for s, v in strings.items() for d, p in v if d == 1)) >= {(1, p) for p in range(2, 25)}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, None, "y", 2)], "doc_id long, text string, block string, kept int")
    assert {(r.id, r.n_words) for r in substring_dedup(docs).collect()} == {(1, 2), (2, 0)}
    assert {(r.id, r.n_bytes) for r in suffix_dedup(docs).collect()} == {(1, 3), (2, 0)}


def test_equal_windows_have_equal_seeds():
    import numpy as np

    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog and the quick brown fox jumps over", np.uint8)
    grams = rolling.gram_hashes(rolling.prefix(data), 6)
    own = rolling.owners(grams, 10)
    a, b = 0, bytes(data).rindex(b"the quick")
    assert [own[a + i] - a for i in range(15)] == [own[b + i] - b for i in range(15)]


def test_a_bucket_of_suffixes_takes_little_memory():
    import tracemalloc

    import numpy as np

    from swayline.llm import seeds
    from swayline.llm.suffix_dedup import cover

    rng, shape, m = np.random.default_rng(1), seeds.Shape(False, 50, 24), 20_000
    keys, n = np.sort(rng.integers(0, m // 5, m)).astype(np.uint64), np.full(m, 20, np.int64)
    sizes = n + shape.window - 1
    body = rng.integers(97, 123, (m // 5, sizes[0])).astype(np.uint8)[keys.astype(int)]
    body[np.arange(m), rng.integers(0, sizes[0], m)] = 65
    tracemalloc.start()
    spans = cover(keys, np.arange(m), np.zeros(m, np.int32), n, sizes, body.ravel(), shape)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans[0]) and peak < 32e6
