"""Features, quantiles, closed-form regressions, rankings and plot tables."""

import math
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swayline.functions.student import with_f_p_value, with_t_p_value
from swayline.operators import controls, features, linear, moments, plotdata, quantiles, ranking


def sample(spark, seed=3, entities=6, rows=60):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(entities):
        for r in range(rows):
            x = float(rng.integers(0, 15))
            out.append((f"e{e}", f"g{e % 2}", 2018 + r % 4, x, float(rng.random() < 0.3 + 0.02 * x + 0.01 * e)))
    return spark.createDataFrame(out, "entity string, group_name string, season int, metric double, outcome double")


def test_cells_give_the_same_features_as_rows(spark):
    rows = sample(spark)
    cells = features.outcome_cells(rows)
    keys = ["entity", "group_name", "season", "metric"]
    for build, columns in ((features.recent_rowz, ["metric_centred_z", "metric_mean_z", "n_games"]),
                           (features.recent_entityz, ["metric_c_z", "metric_mean_z", "n_games"])):
        a = {tuple(r[k] for k in keys): [r[c] for c in columns] for r in build(rows, 5).collect()}
        b = {tuple(r[k] for k in keys): [r[c] for c in columns] for r in build(cells, 5, weight="n_rows").collect()}
        assert a.keys() == b.keys()
        assert all(np.allclose(a[k], b[k], atol=1e-10) for k in a)


def test_within_entity_scores(spark):
    scored = features.recent_entityz(sample(spark), 5)
    for r in scored.groupBy("entity").agg(F.avg("metric_c_z").alias("m"), F.stddev_samp("metric_c_z").alias("s")).collect():
        assert abs(r["m"]) < 1e-12 and r["s"] == pytest.approx(1)
    z = [r[0] for r in scored.select("metric_mean_z", "entity").distinct().collect()]
    assert statistics.mean(z) == pytest.approx(0, abs=1e-12) and statistics.stdev(z) == pytest.approx(1)


def test_constant_metric_has_no_score(spark):
    rows = [("c", "g", 2020, 0.1, 1.0)] * 6 + [("v", "g", 2020, float(i), 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "entity string, group_name string, season int, metric double, outcome double")
    got = {(r["entity"], r["metric_c_z"] is None) for r in features.recent_entityz(df, 2).collect()}
    assert got == {("c", True), ("v", False)}
    cells = features.outcome_cells(df)
    assert {r["sd"] == 0 for r in moments.moments(cells, ["entity"], "metric", "n_rows").where("entity = 'c'").collect()} == {True}
    flags = {r["entity"]: (r["no_spread"], r["no_outcome_variation"]) for r in features.entity_checks(df).collect()}
    assert flags == {"c": (True, True), "v": (False, True)}


def test_one_row_entity(spark):
    df = spark.createDataFrame([("o", "g", 2020, 4.0, 1.0)], "entity string, group_name string, season int, metric double, outcome double")
    r = features.entity_checks(df).first()
    assert r["sd_metric"] is None and r["no_spread"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50).map(lambda v: v / 4), min_size=1, max_size=60))
def test_quantiles_by_ranges_are_exact(spark, monkeypatch, values):
    monkeypatch.setattr(quantiles, "RANGES", 4)
    monkeypatch.setattr(quantiles, "DIRECT_CELLS", 0)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    cells = quantiles.materialise(quantiles.value_cells(df, ["k"], "v"), "cells")
    got = quantiles.cell_quantiles(cells, ["k"], "v", [0.25, 0.5, 0.9]).first()
    want = np.quantile(values, [0.25, 0.5, 0.9])
    assert np.allclose([got["q0"], got["q1"], got["q2"]], want, atol=1e-12)


def test_large_and_small_keys_together(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "DIRECT_CELLS", 20)
    monkeypatch.setattr(quantiles, "RANGES", 8)
    rng = np.random.default_rng(1)
    data = {"small": rng.normal(size=10).tolist(), "large": rng.normal(size=300).tolist()}
    df = spark.createDataFrame([(k, v) for k in data for v in data[k]], "k string, v double")
    cells = quantiles.materialise(quantiles.value_cells(df, ["k"], "v"), "cells")
    for r in quantiles.cell_quantiles(cells, ["k"], "v", [0.5]).collect():
        assert r["q0"] == pytest.approx(statistics.median(data[r["k"]]))


def lstsq_terms(rows):
    names = sorted({r["entity"] for r in rows})
    x, y = np.array([r["metric"] for r in rows]), np.array([r["outcome"] for r in rows])
    D = np.array([[float(r["entity"] == n) for n in names[1:]] for r in rows])
    X = np.column_stack([np.ones(len(x)), x, D, D * x[:, None]])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = np.sum((y - X @ b) ** 2) / (len(y) - X.shape[1])
    se = np.sqrt(s2 * np.diag(np.linalg.inv(X.T @ X)))
    terms = ["(Intercept)", "metric"] + [f"entity{n}" for n in names[1:]] + [f"metric:entity{n}" for n in names[1:]]
    return dict(zip(terms, zip(b, se)))


def test_interaction_model_matches_least_squares(spark):
    df = sample(spark)
    got = {(r["group_name"], r["term"]): r for r in linear.ols_interaction(df, 30).collect()}
    for g in ("g0", "g1"):
        want = lstsq_terms([r for r in df.collect() if r["group_name"] == g])
        assert {t for (gg, t) in got if gg == g} == set(want)
        for t, (b, se) in want.items():
            assert got[(g, t)]["estimate"] == pytest.approx(b, abs=1e-10)
            assert got[(g, t)]["std_error"] == pytest.approx(se, rel=1e-9)


def test_trial_is_the_group_model_on_chosen_entities(spark):
    df = sample(spark)
    got = {r["term"]: r["estimate"] for r in linear.ols_trial(df, ["e0", "e1", "e2"]).collect()}
    want = lstsq_terms([r for r in df.collect() if r["entity"] in ("e0", "e1", "e2")])
    assert all(got[t] == pytest.approx(want[t][0], abs=1e-10) for t in want)


def test_a_chosen_reference_leaves_contrasts_as_they_are(spark):
    df = sample(spark)
    first = {(r["group_name"], r["term"]): r["estimate"] for r in linear.ols_interaction(df, 30).collect()}
    chosen = linear.ols_interaction(df, 30, reference=["nobody", "e2", "e1"]).collect()
    for g in {r["group_name"] for r in chosen}:
        mine = {r["term"]: r for r in chosen if r["group_name"] == g}
        base = {r["reference_entity"] for r in mine.values()}
        entities = {r["entity"] for r in mine.values()}
        want = next((e for e in ("e2", "e1") if e in entities), min(entities))
        assert base == {want}
        was = lambda e: first.get((g, f"metric:entity{e}"), 0.0)
        for e in entities - {want}:
            assert mine[f"metric:entity{e}"]["estimate"] == pytest.approx(was(e) - was(want), abs=1e-10)
        assert mine["metric"]["estimate"] == pytest.approx(first[g, "metric"] + was(want), abs=1e-10)


def test_levels_by_collation(spark):
    """Names are ordered by their lower-case form where asked to; a missing name is never the reference."""
    rows = [(e, "g", float(i), float((i * i + k) % 2)) for k, e in enumerate(["B", "a", "A", None]) for i in range(8)]
    df = spark.createDataFrame(rows, "entity string, group_name string, metric double, outcome double")

    def reference(**how):
        return {r["reference_entity"] for r in linear.ols_interaction(df, 1, **how).collect()}

    assert reference() == {"A"}
    assert reference(collate=lambda c: F.lower(F.translate(c, "A", "z"))) == {"a"}
    assert reference(reference="B") == {"B"}


def test_entity_without_spread_costs_one_parameter(spark):
    rows = [("a", "g", 2.0, float(i % 2)) for i in range(6)] + [
        (e, "g", float(i), float((i * i + k) % 2)) for k, e in enumerate("bc") for i in range(8)]
    df = spark.createDataFrame(rows, "entity string, group_name string, metric double, outcome double")
    terms = linear.ols_interaction(df, 1).collect()
    assert {r["reference_entity"] for r in terms} == {"b"}
    assert {r["df_residual"] for r in terms} == {6 + 8 + 8 - 5}
    assert [r["estimate"] for r in terms if r["term"] == "metric:entitya"] == [None]


def test_order_and_partitions_do_not_matter(spark):
    df = sample(spark)
    a = {r["term"]: r["estimate"] for r in linear.ols_trial(df.repartition(7), ["e0", "e3"]).collect()}
    b = {r["term"]: r["estimate"] for r in linear.ols_trial(df.orderBy("metric").coalesce(1), ["e0", "e3"]).collect()}
    assert all(a[t] == pytest.approx(b[t], abs=1e-12) for t in a)


def test_simple_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    y = 2 + 3 * x + rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["term"]: r for r in linear.ols_summary(df, "x", "y").collect()}
    slope, intercept = np.polyfit(x, y, 1)
    assert got["x"]["estimate"] == pytest.approx(slope) and got["(Intercept)"]["estimate"] == pytest.approx(intercept)
    assert got["x"]["r_squared"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2)
    assert got["x"]["p_value"] < 1e-10


def test_student_p_values(spark):
    # fixed values: published two-sided critical points of the t distribution
    table = [(12.706204736, 1.0, 0.05), (2.228138852, 10.0, 0.05), (2.750, 30.0, 0.01000), (1.959963985, 1e9, 0.05), (0.0, 5.0, 1.0),
             (float("nan"), 5.0, None), (None, 5.0, None), (2.0, 0.0, None), (1e200, 7.0, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "i int, statistic double, df_residual double, want double")
    for r in with_t_p_value(df).collect():
        if r.want is None:
            assert r.p_value is None
        else:
            assert r.p_value == pytest.approx(r.want, rel=2e-4)


def integral(f, above, below, steps=200_000):
    """P(F > f) by the midpoint rule on the density at the square of the variable."""
    u = (np.arange(steps) + 0.5) * math.sqrt(f) / steps
    log = math.lgamma((above + below) / 2) - math.lgamma(above / 2) - math.lgamma(below / 2) + above / 2 * math.log(above / below)
    log = log + (above - 1) * np.log(u) - (above + below) / 2 * np.log1p(above * u * u / below)
    return 1 - 2 * np.exp(log).sum() * math.sqrt(f) / steps


def test_f_p_values(spark):
    cases = [(f, m, n) for f in (0.01, 0.7, 1.0, 2.5, 9.0) for m, n in ((1, 1), (1, 40), (3, 17), (25, 60), (53, 12000), (400, 3))]
    df = spark.createDataFrame([(float(f), m, n) for f, m, n in cases] + [(None, 1, 1), (2.0, 0, 5), (0.0, 2, 5)], "f_statistic double, df_model long, df_residual long")
    for r in with_f_p_value(df).collect():
        if r.f_statistic is None or r.df_model == 0:
            assert r.f_p_value is None
        else:
            want = integral(r.f_statistic, r.df_model, r.df_residual) if r.f_statistic else 1.0
            assert r.f_p_value == pytest.approx(want, abs=1e-8)


def test_fit_tests_match_least_squares(spark):
    df = sample(spark)
    got = linear.ols_interaction(df, 30).where("group_name = 'g0' and term = 'metric'").first()
    rows = [r for r in df.collect() if r["group_name"] == "g0"]
    names = sorted({r["entity"] for r in rows})
    x, y = np.array([r["metric"] for r in rows]), np.array([r["outcome"] for r in rows])
    D = np.array([[float(r["entity"] == n) for n in names[1:]] for r in rows])
    X = np.column_stack([np.ones(len(x)), x, D, D * x[:, None]])
    rss = np.sum((y - X @ np.linalg.lstsq(X, y, rcond=None)[0]) ** 2)
    tss, k, left = np.sum((y - y.mean()) ** 2), X.shape[1] - 1, len(y) - X.shape[1]
    f = (tss - rss) / k / (rss / left)
    assert got.r_squared == pytest.approx(1 - rss / tss) and got.adj_r_squared == pytest.approx(1 - rss / left / (tss / (len(y) - 1)))
    assert got.f_statistic == pytest.approx(f) and got.f_p_value == pytest.approx(integral(f, k, left), abs=1e-7)


def test_ties_and_first_k(spark):
    df = spark.createDataFrame([("g", "a", 3.0), ("g", "b", 3.0), ("g", "c", 1.0), ("g", "d", None), ("h", "e", 2.0)],
                               "group_name string, entity string, v double")
    assert {r["entity"] for r in ranking.top_with_ties(df, "group_name", "v", 1).collect()} == {"a", "b", "e"}
    assert {r["entity"] for r in ranking.first_k(df, "group_name", "v", 1).collect()} == {"a", "e"}
    assert [r["entity"] for r in ranking.ranked(df, "v").collect()] == ["a", "b", "e", "c", "d"]
    assert [r["entity"] for r in ranking.one_group(df, "g", "v", 2).collect()] == ["a", "b"]


def test_flag_is_by_entity_alone(spark):
    df = spark.createDataFrame([("g", "a", 3.0), ("h", "a", 3.0), ("h", "b", 5.0), ("h", "c", 4.0)],
                               "group_name string, entity string, v double")
    got = {(r["group_name"], r["entity"]): r["top3"] for r in ranking.flag_first_k(df, "group_name", "v", 1).collect()}
    assert got == {("g", "a"): True, ("h", "a"): True, ("h", "b"): True, ("h", "c"): False}


def test_top_k_is_trimmed_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "cast(id AS double) AS v", "id AS entity")
    plan = ranking.top_with_ties(df, "g", "v", 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, s in (("a", 1.0), ("b", 3.0)) for v in rng.normal(0, s, 400)]
    df = spark.createDataFrame(rows, "g string, v double")
    for keys in ([], ["g"]):
        d = plotdata.density(df, "v", keys, points=256).toPandas()
        for _, part in d.groupby("g") if keys else [(0, d)]:
            part = part.sort_values("x")
            assert np.trapezoid(part.density, part.x) == pytest.approx(1, abs=0.03)
    values = np.array([v for k, v in rows if k == "a"])
    part = plotdata.density(df, "v", ["g"], points=256).where("g = 'a'").orderBy("x").toPandas()
    iqr = np.subtract(*np.quantile(values, [0.75, 0.25])) / 1.34
    bw = 0.9 * min(values.std(ddof=1), iqr) * len(values) ** -0.2
    direct = [np.mean(np.exp(-((x - values) / bw) ** 2 / 2)) / (bw * math.sqrt(2 * math.pi)) for x in part.x]
    assert np.allclose(part.density, direct, atol=2e-3)


@pytest.mark.parametrize("lo, hi, bins, step", [
    (0.0, 10.0, 5, 2.0), (0.0, 1.0, 7, 0.2), (-3.0, 4.0, 8, 1.0), (0.0, 100.0, 8, 10.0), (0.0, 100.0, 6, 20.0), (0.013, 0.094, 6, 0.01), (0.0, 30.0, 10, 5.0)])
def test_rounded_step(lo, hi, bins, step):
    assert plotdata.rounded_step(lo, hi, bins) == pytest.approx(step)


def test_rounded_histogram(spark):
    values = [-3.0, -2.5, -2.0, 0.0, 0.1, 1.0, 1.0, 3.9, 4.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    bins = plotdata.rounded_histogram(df, "v").orderBy("bin").collect()
    assert bins[0].bin_low <= -3.0 and bins[-1].bin_high >= 4.0
    for b in bins:  # open on the left but for the first
        assert b.n == sum(b.bin_low < v <= b.bin_high or (b.bin == 1 and v == b.bin_low) for v in values)
    assert sum(b.n for b in bins) == len(values)
    (one,) = plotdata.rounded_histogram(spark.createDataFrame([(2.5,)] * 3, "v double"), "v").collect()
    assert (one.bin_low, one.bin_high, one.n) == (2.0, 3.0, 3)
    assert plotdata.rounded_histogram(df.where("v > 100 and not isnan(v)"), "v").count() == 0


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 2, 3, 10)], "v double")
    bins = plotdata.histogram(df, "v").orderBy("bin").collect()
    assert [r["n"] for r in bins] == [4, 1, 0, 1] and bins[-1]["bin_high"] == 10


def test_logit_controls(spark):
    rng = np.random.default_rng(4)
    n = 600
    X = np.column_stack([np.ones(n), rng.integers(0, 10, n), rng.integers(0, 2, n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(X @ [-1, 0.2, 0.4])))).astype(float)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for (_, a, b), c in zip(X, y)], "metric double, final int, outcome double")
    got = {r["term"]: r for r in controls.logit_controls(df, ["metric", "final"]).collect()}
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        cov = np.linalg.inv(X.T @ (X * (p * (1 - p))[:, None]))
        b = b + cov @ (X.T @ (y - p))
    for i, t in enumerate(["(Intercept)", "metric", "final"]):
        assert got[t]["estimate"] == pytest.approx(b[i], abs=1e-5)
        assert got[t]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-3)


def test_density_keeps_keys_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 3.0), ("c", 5.0)], "k string, v double")
    out = plotdata.density(df, "v", ["k"], points=16).collect()
    assert sorted((r.k, r.point, r.x, r.density) for r in out if r.k != "a") == [("b", 0, 3.0, None), ("c", 0, 5.0, None)]
    assert sum(r.k == "a" for r in out) == 16
