"""Correlations and residual quantiles against a dense computation, for forms with every kind of term."""

import numpy as np
import pytest

from swayline.operators import fit_summary, penalised

import dense
from test_mixed import DATA, FORMS, cells_of
from test_penalised import SDS


@pytest.mark.parametrize("name", ["slope", "nested"])
def test_matches_dense(spark, name):
    form, rows = FORMS[name], dense.simulate(**DATA[name])
    groups, entities = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    X, Z, owner = dense.design(rows, form, groups, entities)
    y = np.array([r[4] for r in rows])
    ridge = np.concatenate([np.zeros(X.shape[1]), [1 / SDS[o][1] ** 2 for o in owner]])
    W, at = np.column_stack([X, Z]), np.zeros(X.shape[1] + Z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-W @ at))
        H = W.T @ (W * (p * (1 - p))[:, None]) + np.diag(ridge)
        at = at + np.linalg.solve(H, W.T @ (y - p) - ridge * at)
    covariance = np.linalg.inv(H)[: X.shape[1], : X.shape[1]]
    order = ["(Intercept)", "x", "m"] + ([f"group_name{g}" for g in groups[1:]] if form.group_fixed else [])
    cells = cells_of(spark, rows)
    fit = penalised.fit_at_spreads(cells, form, dict(SDS[o] for o in set(owner)))
    got = {(r["part"], r["term"], r["other"]): r["value"] for r in fit_summary.fit_summary(cells, fit, form).collect()}
    for j, term in enumerate(order):
        for i in range(j):
            want = covariance[i, j] / np.sqrt(covariance[i, i] * covariance[j, j])
            assert got["correlation", term, order[i]] == pytest.approx(want, abs=1e-7)
    want = np.quantile((y - p) / np.sqrt(p * (1 - p)), list(fit_summary.QUANTILES.values()))
    assert np.allclose([got["residual", q, None] for q in fit_summary.QUANTILES], want, atol=1e-6)
    assert len(got) == len(order) * (len(order) - 1) // 2 + 5
