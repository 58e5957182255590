"""Probit models against a dense Newton fit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swayline.functions import normal
from swayline.operators import probit


def phi(x):
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in x])


def dense_probit(X, y, steps=60):
    """Coefficients and expected-information covariance, by pseudo-inverse scoring."""
    b = np.zeros(X.shape[1])
    for _ in range(steps):
        eta = X @ b
        p = np.clip(phi(eta), 1e-12, 1 - 1e-12)
        d = np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
        w = d * d / (p * (1 - p))
        cov = np.linalg.pinv(X.T @ (X * w[:, None]), rcond=1e-11)
        b = b + cov @ (X.T @ (d * (y - p) / (p * (1 - p))))
    return b, cov


def rows_of(seed=5, groups=3, entities=4, rows=80, movers=False, separable=False):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        for e in range(entities):
            a, b = rng.normal(0, 0.4), rng.normal(0.08, 0.05)
            for r in range(rows):
                x = float(rng.integers(0, 12))
                at = (g + 1) % groups if movers and e == 0 and g == 0 and r % 2 else g
                y = float(rng.random() < phi([a - 0.4 + 0.2 * at + b * x])[0])
                if separable and g == 0 and e == 1:
                    y = float(x > 6)
                out.append((f"p{g}{e}", f"t{at}", x, y))
    return out


def cells_of(spark, rows):
    df = spark.createDataFrame(rows, "entity string, group_name string, metric double, outcome double")
    return df.groupBy("entity", "group_name", "metric").agg(
        F.count("outcome").alias("n_known"), F.sum("outcome").alias("wins"))


def test_normal_functions(spark):
    x = [-9.0, -7.5, -3.0, -1.0, -0.1, 0.0, 0.3, 2.0, 7.2]
    df = spark.createDataFrame([(v,) for v in x], "x double").selectExpr(
        "x", f"{normal.cumulative('x')} AS p", f"{normal.two_sided('x')} AS q")
    for r in df.collect():
        assert r["p"] == pytest.approx(phi([r["x"]])[0], rel=1e-9)
        assert r["q"] == pytest.approx(2 * phi([-abs(r["x"])])[0], rel=1e-9)


def test_group_models_match_dense(spark):
    rows = rows_of()
    got = {(r["group_name"], r["term"]): r for r in probit.probit_interaction(cells_of(spark, rows)).collect()}
    for g in ("t0", "t1", "t2"):
        part = [r for r in rows if r[1] == g]
        names = sorted({r[0] for r in part})
        x, y = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        D = np.array([[float(r[0] == n) for n in names[1:]] for r in part])
        b, cov = dense_probit(np.column_stack([np.ones(len(x)), x, D, D * x[:, None]]), y)
        terms = ["(Intercept)", "metric"] + [f"entity{n}" for n in names[1:]] + [f"metric:entity{n}" for n in names[1:]]
        for i, t in enumerate(terms):
            assert got[(g, t)]["estimate"] == pytest.approx(b[i], abs=1e-7)
            assert got[(g, t)]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-6)


def test_separated_entity_is_flagged(spark):
    got = probit.probit_interaction(cells_of(spark, rows_of(separable=True))).where("entity = 'p01'").collect()
    assert {r["separated"] for r in got} == {True}
    assert all(r["estimate"] is None for r in got)


@pytest.mark.parametrize("movers", [False, True])
def test_global_model_matches_dense(spark, movers):
    rows = rows_of(movers=movers)
    got = {r["term"]: r for r in probit.probit_global(cells_of(spark, rows)).collect()}
    names, groups = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    G = np.array([[float(r[1] == g) for g in groups[1:]] for r in rows])
    D = np.array([[float(r[0] == n) for n in names[1:]] for r in rows])
    # drop the level columns that depend on earlier ones, as a sequential fit does
    columns = [np.ones(len(x))] + list(G.T) + [x]
    kept = []
    for i, n in enumerate(names[1:]):
        trial = np.column_stack(columns + [D[:, i]])
        if np.linalg.matrix_rank(trial) == trial.shape[1]:
            columns.append(D[:, i])
            kept.append(n)
    X = np.column_stack(columns + [D[:, i] * x for i in range(D.shape[1])])
    b, cov = dense_probit(X, y)
    terms = ["(Intercept)"] + [f"group_name{g}" for g in groups[1:]] + ["metric"] + [f"entity{n}" for n in kept]
    terms += [f"metric:entity{n}" for n in names[1:]]
    for i, t in enumerate(terms):
        assert got[t]["estimate"] == pytest.approx(b[i], abs=1e-6), t
        assert got[t]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-5), t
    for n in set(names[1:]) - set(kept):
        assert got[f"entity{n}"]["estimate"] is None and got[f"entity{n}"]["std_error"] is None


@pytest.mark.parametrize("movers", [False, True])
def test_a_chosen_reference_leaves_contrasts_as_they_are(spark, movers):
    cells = cells_of(spark, rows_of(movers=movers))

    def terms(fit, **how):
        return {(r["term_kind"], r["entity"]): r for r in fit(cells, **how).collect()}

    for fit in (probit.probit_global, probit.probit_interaction):
        first = terms(fit)
        base = next(iter(first.values()))["reference_entity"]
        other = max(e for kind, e in first if kind == "interaction")
        group = next((r["group_name"] for r in first.values() if r["entity"] == other and "group_name" in r), None)
        chosen = terms(fit, reference=["nobody", other])
        mine = {k: r for k, r in chosen.items() if "group_name" not in r or r["group_name"] == group}
        assert {r["reference_entity"] for r in mine.values()} == {other}
        shift = first["interaction", other]["estimate"]
        for (kind, entity), r in mine.items():
            if kind == "interaction":
                was = first.get((kind, entity))
                assert r["estimate"] == pytest.approx((was["estimate"] if was else 0.0) - shift, abs=1e-7)
        back = mine.get(("interaction", base))
        if back:
            assert back["std_error"] == pytest.approx(first["interaction", other]["std_error"], abs=1e-7)
