"""Mixed models against a dense Laplace, and recovery of planted parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swayline import skew
from swayline.operators import mixed

import dense

FORMS = {
    "slope": mixed.Form(x="x", m="m", group_fixed=True, entity_intercept=False),
    "both": mixed.Form(x="x", m="m"),
    "crossed": mixed.Form(x="x", m="m", group_random=True),
    "crossed_no_m": mixed.Form(x="x", m=None, group_random=True),
    "nested": mixed.Form(x="x", m="m", group_random=True, nested=True),
}
DATA = {
    "slope": dict(seed=1),
    "both": dict(seed=2, sd_intercept=0.7, group_effects=False),
    "crossed": dict(seed=3, sd_intercept=0.7, group_effects=False, sd_group=0.6, movers=0.3),
    "crossed_no_m": dict(seed=4, sd_intercept=0.7, group_effects=False, sd_group=0.6),
    "nested": dict(seed=5, sd_intercept=0.7, group_effects=False, sd_group=0.8, movers=0.6),
}


def cells_of(spark, rows):
    df = spark.createDataFrame(rows, "entity string, group_name string, x double, m double, outcome double")
    return df.groupBy("entity", "group_name", "x", "m").agg(
        F.count("outcome").alias("n_known"), F.sum("outcome").alias("wins"))


@pytest.mark.parametrize("name", list(FORMS))
def test_matches_dense_laplace(spark, name):
    form, rows = FORMS[name], dense.simulate(**DATA[name])
    fit = mixed.fit_mixed(cells_of(spark, rows), form)
    stats = fit.fit_stats.first()
    assert stats["converged"] and not stats["is_singular"]
    groups, entities = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    X, Z, owner = dense.design(rows, form, groups, entities)
    y = np.array([r[4] for r in rows])
    order = ["(Intercept)", "x"] + (["m"] if form.m else [])
    order += [f"group_name{g}" for g in groups[1:]] if form.group_fixed else []
    beta = np.array([fit.fixed[(0, t)] for t in order])
    tag = {("entity", "(Intercept)"): "i", ("entity", "x"): "s", ("group", "(Intercept)"): "g",
           ("entity:group", "(Intercept)"): "n"}
    sds = {tag[k[1:]]: v for k, v in fit.spreads.items() if k != "theta"}
    value, modes = dense.laplace(beta, sds, X, Z, owner, y)
    assert value == pytest.approx(stats["log_lik"], abs=1e-5)
    # the score vanishes at the reported optimum
    h = 1e-4
    for i in range(len(beta)):
        step = np.eye(len(beta))[i] * h
        slope = (dense.laplace(beta + step, sds, X, Z, owner, y)[0]
                 - dense.laplace(beta - step, sds, X, Z, owner, y)[0]) / (2 * h)
        assert abs(slope) < 2e-2
    for k in sds:
        up, down = dict(sds), dict(sds)
        up[k], down[k] = sds[k] + h, sds[k] - h
        slope = (dense.laplace(beta, up, X, Z, owner, y)[0] - dense.laplace(beta, down, X, Z, owner, y)[0]) / (2 * h)
        assert abs(slope) < 2e-2
    # conditional modes
    got = {(r["factor"], r["level"], r["term"]): r["cond_mode"] for r in fit.random_effects.collect()}
    if form.entity_slope:
        want = modes[owner == "s"]
        assert np.allclose([got[("entity", e, "x")] for e in entities], want, atol=1e-4)
    if form.entity_intercept:
        want = modes[owner == "i"]
        assert np.allclose([got[("entity", e, "(Intercept)")] for e in entities], want, atol=1e-4)
    if form.group_random:
        want = modes[owner == "g"]
        assert np.allclose([got[("group", g, "(Intercept)")] for g in groups], want, atol=1e-4)


def test_hard_data_matches_dense_laplace(spark):
    """Large spreads, few rows per entity, entities that always or never win, an uncentred predictor."""
    rows = dense.simulate(61, groups=3, entities=12, rows=7, sd_slope=1.5, sd_intercept=2.0, group_effects=False)
    rows = [(e, g, x + 3.0, m, 1.0 if e.endswith("003") else 0.0 if e.endswith("004") else y) for e, g, x, m, y in rows]
    form = FORMS["both"]
    fit = mixed.fit_mixed(cells_of(spark, rows), form)
    stats = fit.fit_stats.first()
    assert stats["converged"]
    groups, entities = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    X, Z, owner = dense.design(rows, form, groups, entities)
    y = np.array([r[4] for r in rows])
    beta = np.array([fit.fixed[(0, t)] for t in ("(Intercept)", "x", "m")])
    sds = {"i": fit.spreads[(0, "entity", "(Intercept)")], "s": fit.spreads[(0, "entity", "x")]}
    assert dense.laplace(beta, sds, X, Z, owner, y)[0] == pytest.approx(stats["log_lik"], abs=1e-4)
    h = 1e-4
    for i in range(3):
        step = np.eye(3)[i] * h
        assert abs(dense.laplace(beta + step, sds, X, Z, owner, y)[0]
                   - dense.laplace(beta - step, sds, X, Z, owner, y)[0]) / (2 * h) < 2e-2
    for k in sds:
        up, down = {**sds, k: sds[k] + h}, {**sds, k: abs(sds[k] - h)}
        assert abs(dense.laplace(beta, up, X, Z, owner, y)[0] - dense.laplace(beta, down, X, Z, owner, y)[0]) / (2 * h) < 2e-2


def test_recovers_planted_values(spark):
    rows = dense.simulate(11, groups=5, entities=40, rows=100)
    fit = mixed.fit_mixed(cells_of(spark, rows), FORMS["slope"])
    se = {r["term"]: (r["estimate"], r["std_error"]) for r in fit.coefficients.collect()}
    assert abs(se["x"][0] - 0.6) < 3 * se["x"][1]
    assert abs(se["m"][0] - 0.3) < 3 * se["m"][1]
    assert fit.spreads[(0, "entity", "x")] == pytest.approx(0.5, abs=0.1)


def test_no_random_variation_is_singular(spark):
    # for this seed the dense likelihood falls from zero spread on
    rows = dense.simulate(2, groups=3, entities=10, rows=60, sd_slope=0.0)
    fit = mixed.fit_mixed(cells_of(spark, rows), FORMS["slope"])
    groups, entities = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    X, Z, owner = dense.design(rows, FORMS["slope"], groups, entities)
    y = np.array([r[4] for r in rows])
    beta = np.array([fit.fixed[(0, t)] for t in ["(Intercept)", "x", "m", "group_nameg1", "group_nameg2"]])
    sd = fit.spreads[(0, "entity", "x")]
    best = max(dense.laplace(beta, {"s": s}, X, Z, owner, y)[0] for s in (0.0, 0.1, 0.2, 0.3, sd))
    assert dense.laplace(beta, {"s": sd}, X, Z, owner, y)[0] >= best - 1e-6
    assert fit.fit_stats.first()["is_singular"] == (sd < mixed.SINGULAR)
    assert sd < mixed.SINGULAR


def test_side_by_side_fits_equal_single_fits(spark):
    one, two = dense.simulate(21, entities=6), dense.simulate(22, entities=6)
    both = cells_of(spark, one).withColumn("fit", F.lit(0)).unionByName(cells_of(spark, two).withColumn("fit", F.lit(1)))
    joint = mixed.fit_mixed(both, FORMS["slope"])
    for f, rows in enumerate((one, two)):
        single = mixed.fit_mixed(cells_of(spark, rows), FORMS["slope"])
        assert joint.fixed[(f, "x")] == pytest.approx(single.fixed[(0, "x")], abs=1e-4)
        assert joint.spreads[(f, "entity", "x")] == pytest.approx(single.spreads[(0, "entity", "x")], abs=1e-3)


def test_shuffled_join_gives_the_same_fit(spark, monkeypatch):
    rows = dense.simulate(31, entities=6)
    plain = mixed.fit_mixed(cells_of(spark, rows), FORMS["both"])
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    salted = mixed.fit_mixed(cells_of(spark, rows), FORMS["both"])
    assert salted.fixed[(0, "x")] == pytest.approx(plain.fixed[(0, "x")], abs=1e-9)


@pytest.mark.parametrize("name,movers", [("slope", 0.0), ("slope", 0.5), ("both", 0.5), ("level", 0.0)])
def test_analytic_derivatives(spark, name, movers):
    """Gradient and Hessian of the sums against differences of the values that the same sums give."""
    form = {**FORMS, "level": mixed.Form(x="x", m=None, entity_slope=False)}[name]
    cells = cells_of(spark, dense.simulate(71, groups=3, entities=5, rows=30, sd_intercept=0.5, movers=movers))
    rows, groups, _, level, _ = mixed.prepare(cells, form)
    layout = form.layout(len(groups))
    P = len(layout.names)
    theta = np.linspace(-0.3, 0.5, P)
    state = mixed.start_state(rows, theta, layout, None)
    packed = mixed.expand(rows, state, state.count())
    for order in (2, 4):
        value, gradient, hessian, reach, _ = mixed._derive(packed, theta[None], None, layout, order)
        points = theta + mixed._stencil(P, 1e-3)
        values, far, _ = mixed._laplace(packed, points[None], None, layout, order)
        g, h = mixed._differences(values[0], P, 1e-3)
        assert value[0] == pytest.approx(values[0, 0], abs=1e-9) and reach[0] == far[0]
        assert np.allclose(gradient[0], g, atol=2e-4) and np.allclose(hessian[0], h, atol=2e-3)


def test_converged_fits_leave_the_passes(spark):
    """Fits of very unequal difficulty: each ends at its own optimum, and the decrement says so."""
    easy, hard = dense.simulate(81, entities=6), dense.simulate(82, entities=6, sd_slope=2.5)
    both = cells_of(spark, easy).withColumn("fit", F.lit(0)).unionByName(cells_of(spark, hard).withColumn("fit", F.lit(1)))
    joint = mixed.fit_mixed(both, FORMS["slope"])
    assert {r["converged"] for r in joint.fit_stats.collect()} == {True}
    assert joint.random_effects.groupBy("fit").count().where("count = 24").count() == 2
    single = mixed.fit_mixed(cells_of(spark, hard), FORMS["slope"])
    assert joint.spreads[(1, "entity", "x")] == pytest.approx(single.spreads[(0, "entity", "x")], abs=1e-5)


def test_unfound_modes_are_not_converged(spark, monkeypatch):
    monkeypatch.setattr(mixed, "MAX_EXPANSIONS", 2)
    cells = cells_of(spark, dense.simulate(83, entities=6, sd_slope=2.5))
    with pytest.raises(RuntimeError):
        mixed.fit_mixed(cells, FORMS["slope"])
    assert not mixed.fit_mixed(cells, FORMS["slope"], partial=True).fit_stats.first()["converged"]


@pytest.mark.parametrize("name", ["crossed", "crossed_no_m", "nested"])
def test_analytic_derivatives_with_group_modes(spark, name, monkeypatch):
    """The same where group modes tie the entities together; a fit takes no differences."""
    form = FORMS[name]
    cells = cells_of(spark, dense.simulate(72, groups=3, entities=5, rows=30, sd_intercept=0.5, movers=0.5))
    rows, groups, *_ = mixed.prepare(cells, form)
    layout = form.layout(len(groups))
    P = len(layout.names)
    theta = np.linspace(-0.3, 0.5, P)
    theta[[i for i, n in enumerate(layout.names) if n.startswith("sd_")]] = np.linspace(0.3, 0.6, P)[:sum(n.startswith("sd_") for n in layout.names)]
    state = mixed.start_state(rows, theta, layout, None)
    packed = mixed.expand(rows, state, state.count())
    modes = np.zeros((1, 1, len(groups)))
    for order in (2, 2, 4, 4):
        zero = modes
        value, gradient, hessian, reach, modes = mixed._derive(packed, theta[None], zero, layout, order)
        points = theta + mixed._stencil(P, 1e-3)
        values, far, found = mixed._laplace(packed, points[None], np.repeat(zero, len(points), 1), layout, order)
        values, far, found = mixed._laplace(packed, points[None], found, layout, order)  # differences need modes to the last digits
        g, h = mixed._differences(values[0], P, 1e-3)
        assert value[0] == pytest.approx(values[0, 0], abs=1e-6) and reach[0] == pytest.approx(far[0], abs=1e-6)
        assert np.allclose(modes[0, 0], found[0, 0], atol=1e-6)
        if order == 2 or reach[0] < 0.3:
            assert np.allclose(gradient[0], g, atol=2e-4) and np.allclose(hessian[0], h, atol=4e-3)
        state = packed.mapInArrow(mixed.mode_emitter(theta[None, None], modes, layout, order), mixed.STATE)
        packed = mixed.expand(rows, state, state.count())
    assert reach[0] < 1e-3
    monkeypatch.setattr(mixed, "_stencil", None)
    assert mixed.fit_mixed(cells, form, partial=True).fit_stats.first()["converged"]
