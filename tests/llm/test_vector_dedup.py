"""Near-duplicate vectors against all pairs; calibration and collision counts."""

import math
import random

import numpy as np
import pytest

from swayline.llm import vector_dedup
from swayline.llm.vector_dedup import calibrate, colliding, near_vectors, project, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """Links (other ids) and component of every row's id, from all pairs in double precision."""
    root, links = {r[0]: r[0] for r in rows if r[0] is not None}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    distinct = {(i, tuple(v), label) for i, v, label in rows if i is not None and label is not None and sound(v)}
    known = [(i, np.array(v, np.float64), label) for i, v, label in distinct]
    known = [(i, v / np.linalg.norm(v), label) for i, v, label in known]
    for a, (i, v, label) in enumerate(known):
        for j, w, other in known[a + 1 :]:
            if i != j and label == other and len(v) == len(w) and float(v @ w) >= threshold:
                links.setdefault(i, []).append(j)
                links.setdefault(j, []).append(i)
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(links.get(i, [])), find(i)) for i in root}


def vectors(seed, n=260, dim=24):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((12, dim))
    for i in range(n):
        centre = base[rng.integers(12)]
        spread = rng.choice([0.02, 0.2, 0.27, 0.3, 1.5])  # around the threshold, too
        v = centre + spread * rng.standard_normal(dim)
        rows.append((i * 3, [float(np.float32(x)) for x in v * rng.choice([1e-3, 1.0, 50.0])], int(rng.choice([1, 1, 1, 2]))))
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies of one vector
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [float("nan")] * dim, 1), (3004, [float("inf")] + [1.0] * (dim - 1), 1)]
    rows += [(3005, [None] + [1.0] * (dim - 1), 1), (3006, rows[5][1], None), (3007, rows[5][1][:9], 1), (3008, rows[5][1][:9], 1), (None, rows[5][1], 1), rows[7]]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 16)])
def test_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", block)
    rows = vectors(seed)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS node", "0 AS links", "1 AS dim", "2 AS p")
    got = near_vectors(frame).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_repeated_id_with_other_vectors_shares_a_component(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.01], 1)]
    got = {(r.vec_id, r.n_links): r.component_id for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1): 1, (2, 1): 1, (3, 1): 1}


def test_empty_table_and_extreme_lengths(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1.0, -1.0], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_linked_group_returns_one_row_per_class(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.ones(16) + 0.02 * rng.standard_normal(16)], 1) for i in range(900)]
    found = vector_dedup.classes(spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "label", "embedding AS vec"))
    links = vector_dedup.class_links(found).collect()
    assert len(links) == 900 and all(r.links == 899 for r in links)


def test_collisions_are_counted_exactly_and_recall_is_met():
    rng = np.random.default_rng(5)
    x = unit(rng.standard_normal((70, 24)))
    y = unit(np.concatenate((x[:20] + 0.3 * rng.standard_normal((20, 24)) / 24**0.5, rng.standard_normal((41, 24)))))
    a, b = project(x, 40), project(y, 40)
    for least in (1, 20, 36):
        got = {(int(i), int(j)) for i, j in (p for some in colliding(a, b, 0.6, least, False) for p in zip(*some))}
        assert got == {(i, j) for i in range(70) for j in range(61) if (abs(a[:, i] - b[:, j]) <= 0.6).sum() >= least}
        got = {(int(i), int(j)) for i, j in (p for some in colliding(a, a, 0.6, least, True) for p in zip(*some))}
        assert got == {(i, j) for i in range(70) for j in range(i + 1, 70) if (abs(a[:, i] - a[:, j]) <= 0.6).sum() >= least}
    # fresh directions, one pair at the threshold: the share that reaches the count
    width, least = calibrate(0.93, 32, 0.95)
    steps = rng.standard_normal((4000, 32)) * math.sqrt(2 - 2 * 0.93)
    assert 0.93 < ((abs(steps) <= width).sum(1) >= least).mean() < 0.999
    assert calibrate(1.0)[0] < 1e-6
