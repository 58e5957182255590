"""Effects tables, prediction grid and bootstrap on a fitted model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swayline.functions import draws
from swayline.functions.draws import standard_normal, uniform
from swayline.operators import bootstrap, effects, mixed

import dense
from test_mixed import FORMS, cells_of


@pytest.fixture(scope="module")
def fitted(spark):
    rows = dense.simulate(41, groups=3, entities=8, rows=60, sd_intercept=0.5)
    cells = cells_of(spark, rows).cache()
    return cells, mixed.fit_mixed(cells, FORMS["both"])


def test_totals_add_fixed_effects(fitted):
    cells, fit = fitted
    table = effects.entity_effects(fit, FORMS["both"])
    modes = {(r["level"], r["term"]): r["cond_mode"] for r in fit.random_effects.collect()}
    for r in table.collect():
        assert r["total_slope"] == pytest.approx(modes[(r["entity"], "x")] + fit.fixed[(0, "x")])
        assert r["total_intercept"] == pytest.approx(modes[(r["entity"], "(Intercept)")] + fit.fixed[(0, "(Intercept)")])
        assert r["total_effect"] == pytest.approx(r["total_slope"] + r["total_intercept"])
    joined = effects.with_groups(table, cells)
    relative = effects.group_relative(joined)
    for r in relative.groupBy("group_name").agg(F.avg("intercept_std").alias("m")).collect():
        assert abs(r["m"]) < 1e-12
    assert effects.top_slopes(joined, 2).count() == 6 and effects.top_effects(joined, 3).count() == 9
    one = effects.group_table(relative, "g1", 4).collect()
    assert len(one) == 4 and [r["total_effect"] for r in one] == sorted((r["total_effect"] for r in one), reverse=True)


def test_prediction_grid(spark, fitted):
    cells, fit = fitted
    joined = effects.with_groups(effects.entity_effects(fit, FORMS["both"]), cells)
    for r in effects.predict_grid(joined, fit, FORMS["both"], "g0", [-1, 0, 1], m=0.5).collect():
        e = joined.where(F.col("entity") == r["entity"]).first()
        eta = e["total_intercept"] + fit.fixed[(0, "m")] * 0.5 + e["total_slope"] * r["x"]
        assert r["probability"] == pytest.approx(1 / (1 + math.exp(-eta)))
        break


def test_draws_have_the_right_moments(spark):
    df = spark.range(20000).select(uniform("id").alias("u"), standard_normal(F.lit(1), "id").alias("z"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and 0 < r[1] and r[2] < 1
    assert r[3] == pytest.approx(0, abs=0.03) and r[4] == pytest.approx(1, abs=0.03)


def test_bootstrap_repeats_and_covers(spark):
    rows = dense.simulate(51, groups=2, entities=8, rows=80)
    cells = cells_of(spark, rows).cache()
    fit = mixed.fit_mixed(cells, FORMS["slope"])
    rows, groups, *_ = mixed.prepare(cells, FORMS["slope"])
    draw, layout = bootstrap.drawer(fit.spreads["theta"][0], 7), FORMS["slope"].layout(len(groups))
    first, again = draw(rows, layout, [0, 1, 2]), draw(rows.repartition(5), layout, [0, 2])
    assert first.count() == 3 * rows.count() and first.where("wins < 0 or wins > n").isEmpty()
    assert sorted(map(str, first.where("fit <> 1").collect())) == sorted(map(str, again.collect()))
    boot = bootstrap.bootstrap_slopes(cells, fit, FORMS["slope"], replicates=12, seed=7).collect()
    assert len(boot) == 16
    fixed = fit.fixed[(0, "x")]
    assert sum(r["mean_boot"] for r in boot) / 16 == pytest.approx(fixed, abs=0.25)
    assert all(r["ci_lower"] <= r["mean_boot"] <= r["ci_upper"] and r["se_boot"] > 0 for r in boot)


def test_bootstrap_equals_an_independent_simulation(spark):
    """Means and intervals of the slopes against refits of data that numpy drew."""
    rows = dense.simulate(52, groups=2, entities=3, rows=60, sd_slope=0.6)
    cells = cells_of(spark, rows).cache()
    form = FORMS["slope"]
    fit = mixed.fit_mixed(cells, form)
    boot = {r["entity"]: r for r in bootstrap.bootstrap_slopes(cells, fit, form, replicates=400, seed=3).collect()}
    assert {r["n_boot"] for r in boot.values()} == {400}
    rng, drawn = np.random.default_rng(8), []
    sd = fit.spreads[(0, "entity", "x")]
    for replicate in range(400):
        own = {e: rng.normal(0, sd) for e in {r[0] for r in rows}}
        for e, g, x, m, _ in rows:
            eta = fit.fixed[(0, "(Intercept)")] + fit.fixed.get((0, f"group_name{g}"), 0.0) + fit.fixed[(0, "m")] * m + (fit.fixed[(0, "x")] + own[e]) * x
            drawn.append((e, g, x, m, float(rng.random() < 1 / (1 + math.exp(-eta))), replicate))
    frame = spark.createDataFrame(drawn, "entity string, group_name string, x double, m double, outcome double, fit int")
    refits = mixed.fit_mixed(frame.groupBy("fit", "entity", "group_name", "x", "m").agg(F.count("outcome").alias("n_known"), F.sum("outcome").alias("wins")), form, partial=True)
    slopes = {}
    for r in effects.entity_effects(refits, form).collect():
        slopes.setdefault(r["entity"], []).append(r["total_slope"])
    for e, values in slopes.items():
        error = np.std(values) / len(values) ** 0.5
        assert abs(np.mean(values) - boot[e]["mean_boot"]) < 6 * error
        assert abs(np.std(values) - boot[e]["se_boot"]) < 0.2 * np.std(values)
        for side, share in (("ci_lower", 0.025), ("ci_upper", 0.975)):
            assert abs(np.quantile(values, share) - boot[e][side]) < 0.6 * np.std(values)


def test_binomial_inversion():
    rng = np.random.default_rng(1)
    trials, p = rng.integers(0, draws.TRIALS + 1, 4000), rng.random(4000)
    u = rng.random(4000)
    for n, q, x, got in zip(trials.tolist(), p, u, draws.inverted(trials, p, u).tolist()):
        rare = min(q, 1 - q)
        below, k = (1 - rare) ** n, 0
        while below < x and k < n:
            k += 1
            below += math.comb(n, k) * rare**k * (1 - rare) ** (n - k)
        assert got == (n - k if q > 0.5 else k)
    assert draws.inverted(np.array([5, 5, 0]), np.array([0.0, 1.0, 0.5]), np.array([0.5, 0.5, 0.5])).tolist() == [0, 5, 0]


def test_binomial_of_many_trials(spark):
    r = spark.range(4000).select(draws.binomial(F.lit(1000.0), F.lit(0.3), F.xxhash64("id")).alias("k")).agg(
        F.avg("k").alias("m"), F.stddev("k").alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    assert r.m == pytest.approx(300, abs=1) and r.s == pytest.approx(math.sqrt(210), rel=0.06) and r.lo > 230 and r.hi < 370


def test_bootstrap_writes_nothing_that_grows_with_the_replicates(spark, monkeypatch):
    """Tables written are those of the cells; blocks of replicates change nothing."""
    import os

    from swayline.scratch import scratch_dir

    def written():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(scratch_dir(spark).removeprefix("file:")) for f in files)

    cells = cells_of(spark, dense.simulate(53, groups=2, entities=8, rows=40, movers=0.3)).cache()
    fit = mixed.fit_mixed(cells, FORMS["slope"])
    sizes, found = [written()], []
    for replicates, bound in ((6, bootstrap.GROUP_CELLS), (150, bootstrap.GROUP_CELLS), (6, 40)):
        monkeypatch.setattr(bootstrap, "GROUP_CELLS", bound)
        found.append(bootstrap.bootstrap_slopes(cells, fit, FORMS["slope"], replicates=replicates).collect())
        sizes.append(written())
    assert sizes[2] - sizes[1] < 1.2 * (sizes[1] - sizes[0])
    assert {r["n_boot"] for r in found[1]} == {150}
    for r, s in zip(found[0], found[2]):
        assert r["entity"] == s["entity"] and r["n_boot"] == s["n_boot"] == 6
        assert r["mean_boot"] == pytest.approx(s["mean_boot"], abs=1e-9) and r["ci_upper"] == pytest.approx(s["ci_upper"], abs=1e-9)


def test_a_pass_is_given_no_value_for_each_cell_and_replicate(spark):
    """What reaches the tasks grows with cells and with entities times replicates; the keys made there are Spark's."""
    cells = cells_of(spark, dense.simulate(54, groups=2, entities=4, rows=40, movers=0.3)).cache()
    rows, groups, *_ = mixed.prepare(cells, FORMS["slope"])
    rows, fits, seed = rows.withColumn("blocks", F.lit(1)), list(range(30)), 5
    layout = FORMS["slope"].layout(len(groups))
    given = bootstrap.ready(rows.select("entity", "place", "m", "x", "n", "blocks"), fits, seed, layout, 3)
    arrays = [c for c, kind in given.dtypes if kind.startswith("array")]
    sent = given.agg(*[F.sum(F.coalesce(F.size(F.col(c)), F.lit(0))).alias(c) for c in arrays]).first()
    assert all(sent[c] is None or sent[c] <= 8 * len(fits) for c in arrays) and rows.count() > 100
    tag = F.lit(seed)
    keyed = rows.select("place", "x", *[F.xxhash64(tag, F.lit(f), "entity").alias(f"s{f}") for f in (0, 29)],
                        *[bootstrap.cell_key(tag, F.lit(f)).alias(f"k{f}") for f in (0, 29)]).unionAll(
        spark.range(1).select(F.lit(-3), F.lit(-0.0), F.lit(7), F.lit(8), F.xxhash64(F.lit(-3), F.lit(-0.0)), F.lit(0))).toPandas()
    made = keyed[keyed.place >= 0]
    for f in (0, 29):
        start = draws.hashed_on(made[f"s{f}"].to_numpy().view(np.uint64), made.place.to_numpy().astype(np.int32))
        assert (draws.hashed_on(start, made.x.to_numpy()).view(np.int64) == made[f"k{f}"].to_numpy()).all()
    odd = draws.hashed_on(draws.hashed_on(np.array([42], np.uint64), np.array([-3], np.int32)), np.array([-0.0]))
    assert odd.view(np.int64)[0] == keyed[keyed.place < 0].k0.iloc[0]


@pytest.mark.parametrize("spreads", [("sd_intercept", "sd_slope"), ("sd_slope",), ("sd_intercept",)])
def test_derivatives_of_drawn_replicates_by_differences(spreads):
    """Value, gradient and Hessian of an entity in three places, in its replicates, against differences of the value."""
    import pyarrow as pa

    from swayline.functions.laplace import Layout
    from swayline.functions.replicates import Drawn

    rng, cells, fits = np.random.default_rng(4), 30, 6
    layout = Layout(("intercept", "x", "m", "group1", "group2", *spreads), 3)
    truth = np.array([-0.4, 0.2, 0.1, 0.3, -0.2, *[0.4, 0.3][: len(spreads)]])

    def one(values):
        return pa.array([None] * 3 + [values] + [None] * (cells - 4), pa.list_(pa.from_numpy_dtype(values.dtype)))

    table = pa.table({
        "entity": ["e"] * cells, "block": np.zeros(cells, np.int32), "blocks": np.ones(cells, np.int32), "place": rng.integers(0, 3, cells).astype(np.int32),
        "m": np.full(cells, 0.5), "x": rng.normal(size=cells), "n": rng.integers(1, 90, cells).astype(float), "seeds": one(rng.integers(-2**62, 2**62, fits)),
        "slope_draws": one(rng.normal(size=fits)), "level_draws": one(rng.normal(size=fits))})
    drawn = Drawn(table, np.arange(fits), truth, layout)
    points = truth + rng.normal(size=(fits, len(truth))) * 0.05

    def found(at):
        solved, good = drawn.solve(at)
        assert good.all()
        value, gradient, hessian = solved.derivatives()
        return value, gradient, hessian.reshape(fits, len(truth), -1)

    value, gradient, hessian = found(points)
    for i in range(len(truth)):
        step = 1e-4 * np.eye(len(truth))[i]
        up, down = found(points + step), found(points - step)
        assert np.allclose((up[0] - down[0]) / 2e-4, gradient[:, i], atol=1e-4, rtol=1e-5)
        assert np.allclose((up[1] - down[1]) / 2e-4, hessian[:, i], atol=1e-3, rtol=1e-4)
    assert value.shape == (fits,) and (drawn.wins.sum(0) <= table.column("n").to_numpy().sum()).all()
