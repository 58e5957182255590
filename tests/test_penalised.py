"""Fits at given spreads against a dense joint Newton ascent."""

import numpy as np
import pytest

from swayline.operators import mixed, penalised

import dense
from test_mixed import DATA, FORMS, cells_of

SDS = {"i": ("sd_intercept", 0.6), "s": ("sd_slope", 0.5), "n": ("sd_nested", 0.4), "g": ("sd_group", 0.7)}


def joint(X, Z, owner, y, sds):
    """Fixed effects, modes, standard errors and Laplace value of the joint maximum."""
    ridge = np.concatenate([np.zeros(X.shape[1]), [1 / sds[o] ** 2 for o in owner]])
    W, at = np.column_stack([X, Z]), np.zeros(X.shape[1] + Z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-W @ at))
        H = W.T @ (W * (p * (1 - p))[:, None]) + np.diag(ridge)
        at = at + np.linalg.solve(H, W.T @ (y - p) - ridge * at)
    k = X.shape[1]
    eta = W @ at
    value = np.sum(y * eta - np.logaddexp(0, eta)) - ridge @ at**2 / 2
    value -= np.linalg.slogdet(H[k:, k:] / np.sqrt(np.outer(ridge[k:], ridge[k:])))[1] / 2
    return at[:k], at[k:], np.sqrt(np.diag(np.linalg.inv(H)))[:k], value


@pytest.mark.parametrize("name", list(FORMS))
def test_matches_dense_newton(spark, name):
    form, rows = FORMS[name], dense.simulate(**DATA[name])
    groups, entities = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    X, Z, owner = dense.design(rows, form, groups, entities)
    y = np.array([r[4] for r in rows])
    beta, modes, errors, value = joint(X, Z, owner, y, {o: SDS[o][1] for o in set(owner)})
    fit = penalised.fit_at_spreads(cells_of(spark, rows), form, dict(SDS[o] for o in set(owner)))
    order = ["(Intercept)", "x"] + (["m"] if form.m else [])
    order += [f"group_name{g}" for g in groups[1:]] if form.group_fixed else []
    found = {r["term"]: r for r in fit.coefficients.collect()}
    assert np.allclose([found[t]["estimate"] for t in order], beta, atol=1e-8)
    assert np.allclose([found[t]["std_error"] for t in order], errors, atol=1e-8)
    assert fit.fit_stats.first()["log_lik"] == pytest.approx(value, abs=1e-7)
    got = {(r["factor"], r["level"], r["term"]): r["cond_mode"] for r in fit.random_effects.collect()}
    for factor, term, mark in (("entity", "x", "s"), ("entity", "(Intercept)", "i")):
        if mark in owner:
            assert np.allclose([got[(factor, e, term)] for e in entities], modes[owner == mark], atol=1e-8)
    if "g" in owner:
        assert np.allclose([got[("group", g, "(Intercept)")] for g in groups], modes[owner == "g"], atol=1e-8)
    if "n" in owner:
        pairs = sorted({(r[0], r[1]) for r in rows})
        assert np.allclose([got[("entity:group", f"{e}:{g}", "(Intercept)")] for e, g in pairs], modes[owner == "n"], atol=1e-8)


def test_fitted_spreads_give_the_laplace_value(spark):
    """At the fitted spreads the joint fit lies close to, and not above, the fit that also searches them."""
    cells = cells_of(spark, dense.simulate(**DATA["both"]))
    full = mixed.fit_mixed(cells, FORMS["both"])
    spreads = {"sd_intercept": full.spreads[(0, "entity", "(Intercept)")], "sd_slope": full.spreads[(0, "entity", "x")]}
    fit = penalised.fit_at_spreads(cells, FORMS["both"], spreads)
    best = full.fit_stats.first()["log_lik"]
    assert best - 0.5 < fit.fit_stats.first()["log_lik"] <= best + 1e-6


def test_extremes(spark):
    """Far predictors and entities that always or never win; a step that is too long is taken back."""
    rows = dense.simulate(61, groups=3, entities=12, rows=7, sd_slope=1.5, sd_intercept=2.0, group_effects=False)
    rows = [(e, g, 5 * x + 30.0, m, 1.0 if e.endswith("003") else 0.0 if e.endswith("004") else y) for e, g, x, m, y in rows]
    rows += [("none", None, 1.0, 1.0, 1.0), (None, "g0", 1.0, 1.0, 1.0), ("gap", "g0", None, 1.0, 1.0), ("wait", "g0", 1.0, 1.0, None)]
    whole = [r for r in rows if None not in r]
    groups, entities = sorted({r[1] for r in whole}), sorted({r[0] for r in whole})
    X, Z, owner = dense.design(whole, FORMS["both"], groups, entities)
    fit = penalised.fit_at_spreads(cells_of(spark, rows), FORMS["both"], {"sd_intercept": 2.0, "sd_slope": 1.5})
    beta = np.array([fit.fixed[(0, t)] for t in ("(Intercept)", "x", "m")])
    modes = {(r["level"], r["term"]): r["cond_mode"] for r in fit.random_effects.collect()}
    at = np.concatenate([beta, [modes[e, "(Intercept)"] for e in entities], [modes[e, "x"] for e in entities]])
    W = np.column_stack([X, Z])
    ridge = np.concatenate([np.zeros(3), [1 / 4.0] * len(entities), [1 / 2.25] * len(entities)])
    score = W.T @ (np.array([r[4] for r in whole]) - 1 / (1 + np.exp(-W @ at))) - ridge * at
    assert np.max(np.abs(score)) < 1e-6
    assert fit.fit_stats.first()["n_entities"] == len(entities)


@pytest.mark.parametrize("spreads", [{}, {"sd_intercept": 1.0}, {"sd_intercept": 1.0, "sd_slope": 0.0}])
def test_spreads_must_fit_the_form(spark, spreads):
    with pytest.raises(ValueError):
        penalised.fit_at_spreads(cells_of(spark, dense.simulate(1)), FORMS["both"], spreads)


def test_no_rows(spark):
    with pytest.raises(ValueError):
        penalised.fit_at_spreads(cells_of(spark, []), FORMS["both"], {"sd_intercept": 1.0, "sd_slope": 1.0})
