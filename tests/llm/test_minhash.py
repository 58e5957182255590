"""Near-duplicates against all pairs; the sketch itself."""

import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, tricky_docs

from swayline.llm import minhash
from swayline.llm.components import components
from swayline.llm.minhash import fast_sketch, near_duplicates, shingle_sets


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k):
    docs = {r[0]: sets_of(r[1], k) for r in rows if r[0] is not None}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = docs[i], docs[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(docs[i]), find(i)) for i in ids}


def chain_docs():
    """A chain of documents, each near the next but far from the others, and a wide group around one text."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 + i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(30)]
    base = [f"B{i}" for i in range(150)]
    for i in range(80):
        edit = list(base)
        edit[(i * 2) % 150] = f"x{i}"
        if i % 3 == 0:
            edit[(i * 7 + 40) % 150] = f"y{i}"
        rows.append((5000 - i, " ".join(edit)))
    return [(i, t, None, None, None) for i, t in rows]


@pytest.mark.parametrize("k,block,first", [(4, 1000, 16), (5, 10, 1)])
def test_against_all_pairs(spark, monkeypatch, k, block, first):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FIRST_PAIRS", first)
    rows = tricky_docs(9) + chain_docs()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), k=k).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.id], r.id
            assert r.kept == (r.id == want[r.id][1])


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [base[:600], base[150:750], base[:1], base[:3], base[600:900]]
    docs = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    sketch = fast_sketch(docs, np.concatenate(sets), 5, 200)
    assert (sketch != minhash.EMPTY).all()
    assert abs((sketch[0] == sketch[1]).mean() - 450 / 750) < 0.12
    assert (sketch[0] == sketch[4]).mean() == 0
    alone = fast_sketch(np.zeros(3, np.int64), sets[3], 1, 200)
    assert (alone[0] == sketch[3]).all()


def test_short_texts_are_one_shingle():
    docs, hashes = shingle_sets(pa.array(["a b", None, "A  b", "", "a b c d", "b a"]), 4)
    assert docs.tolist() == [0, 2, 4, 5] and hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    root = {i: i for p in pairs for i in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == r for i, r in root.items() if any(i in p and p[0] != p[1] for p in pairs))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_row_without_id_before_its_twin(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "changed"])
    rows = [(None, " ".join(words), None, None, None), (1, " ".join(words), None, None, None), (2, near, None, None, None)]
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        got = near_duplicates(spark.createDataFrame(order, SCHEMA).coalesce(1), k=4).collect()
        assert {(r.id, r.component_id, r.kept) for r in got} == {(None, None, True), (1, 1, True), (2, 1, False)}


def test_clashing_columns_and_long_text(spark):
    long = " ".join(f"t{i}" for i in range(300_000))
    rows = [(3, long, None, None, None), (4, long + " end", None, None, None), (5, "a b c d e", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS node", "3 AS bands", "'x' AS root", "4 AS n_shingles", "5 AS sign")
    assert {(r.id, r.component_id) for r in near_duplicates(frame, k=4).collect()} == {(3, 3), (4, 3), (5, 5)}


def test_linked_group_returns_a_forest():
    """Joined groups equal the components of all links, in whatever steps the pairs come."""
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 1 << 48, 40, dtype=np.uint64))
    own = [np.sort(rng.choice(base, rng.integers(30, 41), replace=False)) for _ in range(50)]
    ends = np.cumsum([len(x) for x in own])
    i, j = np.triu_indices(50, 1)
    links = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if 100 * len(np.intersect1d(own[a], own[b])) >= 80 * len(np.union1d(own[a], own[b]))}
    assert 20 < len(links) < len(i)
    assert (minhash._reaching(np.concatenate(own), ends, i, j, 80) == [p in links for p in zip(i.tolist(), j.tolist())]).all()
    root = list(range(50))
    for _ in range(50):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert minhash._joined(np.arange(50), np.concatenate(own), ends, i, j, 80).tolist() == root
