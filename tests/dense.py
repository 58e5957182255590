"""Independent dense numpy versions of the fitted models, for small data only."""

import math

import numpy as np


def simulate(seed, groups=4, entities=8, rows=40, sd_slope=0.5, sd_intercept=0.0, sd_group=0.0,
             group_effects=True, movers=0.0):
    """Rows (entity, group_name, x, m, outcome) from a known model."""
    rng = np.random.default_rng(seed)
    out = []
    effect = np.linspace(-0.6, 0.6, groups) if group_effects else rng.normal(0, sd_group, groups)
    for g in range(groups):
        for e in range(entities):
            m = rng.normal()
            u0, u1 = rng.normal(0, sd_intercept), rng.normal(0, sd_slope)
            for r in range(rows):
                at = g
                if movers and e < movers * entities and r >= rows // 2:
                    at = (g + 1) % groups
                x = round(rng.normal(), 1)
                eta = -0.2 + 0.6 * x + 0.3 * m + effect[at] + u0 + u1 * x
                out.append((f"e{g}_{e:03d}", f"g{at}", float(x), float(m), float(rng.random() < 1 / (1 + math.exp(-eta)))))
    return out


def design(rows, form, groups, entities):
    """Dense fixed and random design matrices in the order of the model's parameters."""
    n = len(rows)
    X = [np.ones(n), np.array([r[2] for r in rows])]
    if form.m:
        X.append(np.array([r[3] for r in rows]))
    g = np.array([groups.index(r[1]) for r in rows])
    e = np.array([entities.index(r[0]) for r in rows])
    if form.group_fixed:
        X += [(g == k).astype(float) for k in range(1, len(groups))]
    Z, owner = [], []
    x = X[1]
    one = np.eye(len(entities))[e]
    if form.entity_intercept:
        Z.append(one)
        owner += ["i"] * len(entities)
    if form.entity_slope:
        Z.append(one * x[:, None])
        owner += ["s"] * len(entities)
    if form.nested:
        pairs = sorted(set(zip(e, g)))
        index = {p: k for k, p in enumerate(pairs)}
        block = np.zeros((n, len(pairs)))
        block[np.arange(n), [index[p] for p in zip(e, g)]] = 1
        Z.append(block)
        owner += ["n"] * len(pairs)
    if form.group_random:
        Z.append(np.eye(len(groups))[g])
        owner += ["g"] * len(groups)
    return np.column_stack(X), np.column_stack(Z), np.array(owner)


def laplace(beta, sds, X, Z, owner, y):
    """Laplace log-likelihood by Newton on all random effects at once."""
    scale = np.array([sds[o] for o in owner])
    ZL = Z * scale
    u = np.zeros(Z.shape[1])

    def inner(u):
        eta = X @ beta + ZL @ u
        return np.sum(y * eta - np.logaddexp(0, eta)) - u @ u / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-(X @ beta + ZL @ u)))
        A = np.eye(len(u)) + ZL.T @ (ZL * (p * (1 - p))[:, None])
        step = np.linalg.solve(A, ZL.T @ (y - p) - u)
        while inner(u + step) < inner(u) - 1e-12:
            step = step / 2
        u = u + step
        if np.max(np.abs(step)) < 1e-12:
            break
    eta = X @ beta + ZL @ u
    p = 1 / (1 + np.exp(-eta))
    A = np.eye(len(u)) + ZL.T @ (ZL * (p * (1 - p))[:, None])
    value = np.sum(y * eta - np.logaddexp(0, eta)) - u @ u / 2 - np.linalg.slogdet(A)[1] / 2
    return value, u * scale
