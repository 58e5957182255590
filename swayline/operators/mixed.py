"""Logistic mixed models by Laplace approximation, fitted with grouped Spark aggregates.

Input are cells (see ``features.outcome_cells``). In every model a row enters through
``a + b * x`` where a and b belong to its (entity, group) pair. One *expansion* pass sums the
log-likelihood and its derivatives per pair around the current (a, b): a plain grouped
aggregate, combined on the map side, so hot entities are no burden. The driver's Newton steps
then work on those sums, which are one short row per pair and stay distributed; only the
summed values at the trial parameter points reach the driver. After the parameters have
moved, the sums are expanded again around the new point. At convergence the centre is the
solution, so the expansion no longer approximates anything.
"""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayline.functions.jets import Jet
from swayline.functions.laplace import SUMS, Layout, deriver, evaluator, group_deriver, group_slots, mode_emitter
from swayline.functions.normal import two_sided
from swayline.scratch import materialise
from swayline.skew import attach

SINGULAR = 1e-4
STATE = "fit int, entity string, place int, m double, a double, b double, n double, " \
        "intercept_mode double, slope_mode double, nested_mode double"
VALUES = "fit int, place int, value double"
#: Newton decrement (twice the log-likelihood still to be gained) and distance of the modes from the centre at convergence.
DECREMENT, NEAR = 1e-8, 1e-3
#: Passes after which fits count as not converged.
MAX_EXPANSIONS = 200
#: (entity, group) pairs that a task packs, where there are more than a task for each core.
PAIRS_PER_TASK = 50_000


@dataclass
class MixedFit:
    """Result tables of one fitted model (or of several, told apart by ``fit``)."""

    coefficients: DataFrame
    random_effects: DataFrame
    variance_components: DataFrame
    fit_stats: DataFrame
    fixed: dict
    spreads: dict
    #: number of a fit -> (names of its fixed effects, their covariance)
    covariance: dict


@dataclass(frozen=True)
class Form:
    """Which terms the model has: outcome ~ x [+ m] [+ group] + (entity terms) [+ (1 | group)]."""

    x: str = "metric_c_z"
    m: str = "metric_mean_z"
    group_fixed: bool = False
    entity_intercept: bool = True
    entity_slope: bool = True
    group_random: bool = False
    nested: bool = False

    def layout(self, groups):
        names = ["intercept", "x"] + (["m"] if self.m else [])
        if self.group_fixed:
            names += [f"group{g}" for g in range(1, groups)]
        for name, used in (("sd_intercept", self.entity_intercept), ("sd_slope", self.entity_slope),
                           ("sd_nested", self.nested), ("sd_group", self.group_random)):
            names += [name] if used else []
        return Layout(tuple(names), groups)


def prepare(cells, form, weight="n_known", wins="wins"):
    """Complete cases as (fit, entity, place, m, x, n, wins), scaled; plus group names, scales and sizes.

    x is only divided by its spread, as shifting it would change what the independent
    intercepts and slopes mean; m is a plain covariate and is centred too.
    """
    m = F.col(form.m) if form.m else F.lit(0.0)
    fit = F.col("fit") if "fit" in cells.columns else F.lit(0)
    rows = cells.select(
        fit.cast("int").alias("fit"), "entity", "group_name", m.cast("double").alias("m"),
        F.col(form.x).cast("double").alias("x"), F.col(weight).cast("double").alias("n"), F.col(wins).alias("wins"),
    ).where("n > 0 and entity is not null and group_name is not null and x is not null and m is not null")
    rows = materialise(
        rows.groupBy("fit", "entity", "group_name", "m", "x").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins")),
        "design",
    )
    if form.m:  # the sums per pair take one value of m for an entity
        varying = rows.groupBy("fit", "entity").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo < hi")
        if not varying.isEmpty():
            raise ValueError(f"{form.m} must be constant within an entity")
    parts = rows.groupBy("fit", "group_name").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("x2"),
        F.sum(F.col("n") * F.col("m")).alias("m1"), F.min("m").alias("mlo"), F.max("m").alias("mhi"),
        F.sum("wins").alias("wins"),
    ).collect()  # one row per fit and group
    if not parts:
        raise ValueError("no complete rows to fit")
    groups = sorted({r["group_name"] for r in parts})
    total = {c: sum(r[c] for r in parts) for c in ("n", "x2", "m1", "wins")}
    x_scale = math.sqrt(total["x2"] / total["n"]) or 1.0
    m_mean = total["m1"] / total["n"]
    m_scale = (max(r["mhi"] for r in parts) - min(r["mlo"] for r in parts)) / 4 or 1.0
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group_name")) - 1
    scaled = rows.select(
        "fit", "entity", place.cast("int").alias("place"), ((F.col("m") - m_mean) / m_scale).alias("m"),
        (F.col("x") / x_scale).alias("x"), "n", "wins",
    )
    scales = {"x": x_scale, "m": m_scale, "m_mean": m_mean}
    rate = min(max(total["wins"] / total["n"], 1e-6), 1 - 1e-6)
    sizes = np.zeros(1 + max(r["fit"] for r in parts))
    for r in parts:
        sizes[r["fit"]] += r["n"]
    return scaled, groups, scales, math.log(rate / (1 - rate)), sizes


def start_state(rows, theta, layout, fits):
    """One row per (fit, entity, group) with its covariate, size and the fixed part of ``theta`` as the centre."""
    zero = F.lit(0.0)

    def value(name):
        at = layout.at(name)
        return F.lit(0.0 if at is None else float(theta[at]))

    offsets = F.array(*[value(f"group{g}") for g in range(layout.groups)])
    pairs = rows.groupBy("fit", "entity", "place").agg(F.max("m").alias("m"), F.sum("n").alias("n"))
    if fits is not None:
        pairs = pairs.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))))
    return pairs.select(
        "fit", "entity", "place", "m", (value("intercept") + value("m") * F.col("m") + F.get(offsets, F.col("place"))).alias("a"),
        value("x").alias("b"), "n",
        zero.alias("intercept_mode"), zero.alias("slope_mode"), zero.alias("nested_mode"),
    )


def expand(rows, state, size):
    """Packs, per (fit, entity), the pair sums of the log-likelihood and its derivatives.

    An entity has at most as many pairs as there are groups, so the packed arrays stay short.
    """
    keys = ["fit", "entity", "place"]
    joined = attach(
        rows.select(*keys, "x", F.col("n").alias("trials"), "wins"), state.select(*keys, "m", "a", "b", "n"), keys,
        size=size, scanned=True,
    )
    powers = {0: "", 1: " * x", 2: " * x * x", 3: " * x * x * x", 4: " * x * x * x * x"}
    by_order = [
        "wins * eta - trials * (greatest(eta, 0D) + log1p(exp(-abs(eta))))",
        "(wins - trials * p)", "-trials * w", "-trials * w * (1 - 2 * p)", "-trials * w * (1 - 6 * w)",
    ]
    sums = [
        F.expr(f"sum({by_order[int(d[0]) + int(d[1])]}{powers[int(d[1])]}) AS s{d}") for d in SUMS
    ]
    base = joined.selectExpr("*", "a + b * x AS eta").selectExpr("*", "1 / (1 + exp(-eta)) AS p")
    pairs = base.selectExpr("*", "p * (1 - p) AS w").groupBy(*keys).agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("m", "n", "a", "b")], *sums
    )
    flat = F.expr("array(n, a, b, " + ", ".join(f"s{d}" for d in SUMS) + ")")
    packed = pairs.groupBy("fit", "entity").agg(
        F.max("m").alias("m"), F.collect_list(F.struct("place", flat.alias("sums"))).alias("pairs")
    )
    packed = packed.select(
        "fit", "entity", "m", F.col("pairs.place").alias("places"), F.flatten("pairs.sums").alias("sums")
    )
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, size // 16), size // PAIRS_PER_TASK)
    return materialise(packed.repartition(tasks, "fit", "entity"), "pairs")


def summed(packed, function, fits, size):
    """Sums (F, size) and largest reach (F,) over all tasks, added up in Spark by (fit, place)."""
    parts = packed.mapInArrow(function, VALUES).groupBy("fit", "place").agg(F.sum("value").alias("sum"), F.max("value").alias("most"))
    table = parts.toArrow()
    fit, place, total, most = (table.column(c).to_numpy() for c in ("fit", "place", "sum", "most"))
    sums, reach = np.zeros((fits, size)), np.full(fits, np.nan)
    inside = place >= 0
    sums[fit[inside], place[inside]] = total[inside]
    reach[fit[~inside]] = most[~inside]
    return sums, reach


def _laplace(packed, points, modes, layout, order):
    """Laplace log-likelihood (F, K), the modes' distance from the centre (F,), and group modes (F, K, G)."""
    fits, K, _ = points.shape
    G = layout.groups
    if modes is None:
        return *summed(packed, evaluator(points, None, layout, order), fits, K), None
    for _ in range(20):
        sums, reach = summed(packed, evaluator(points, modes, layout, order), fits, K * (1 + G + G * G))
        values, gradient = sums[:, :K], sums[:, K : K + K * G].reshape(fits, K, G) - modes
        hessian = sums[:, K + K * G :].reshape(fits, K, G, G) + np.eye(G)
        step = np.linalg.solve(hessian, gradient[..., None])[..., 0]
        done = np.max(np.abs(step)) < 1e-6
        values = values - (modes**2).sum(axis=2) / 2 + (gradient * step).sum(axis=2) / 2
        values = values - np.linalg.slogdet(hessian)[1] / 2
        modes = modes + np.clip(step, -2, 2)
        if done:
            return values, reach, modes
    return values, np.full(fits, np.inf), modes  # group modes not found: no fit counts as converged


def _derive(packed, theta, modes, layout, order):
    """Value (F,), gradient (F, P) and Hessian (F, P, P) at ``theta``, reach (F,), group modes (F, 1, G) or None.

    Derivatives are exact, so each takes one point. Where entities share parameters only, theirs add up. Group modes
    tie all entities together: near the modes the sums come with derivatives in parameters and group levels, and
    ``_joined`` lets the modes follow the parameters.
    """
    fits, P = theta.shape
    if modes is None:
        if layout.by_entity():
            sums, reach = summed(packed, deriver(theta, layout, order), fits, 1 + P + P * P)
            return sums[:, 0], sums[:, 1 : 1 + P], sums[:, 1 + P :].reshape(fits, P, P), reach, None
        modes = np.zeros((fits, 1, layout.groups))
    G, N = layout.groups, P + layout.groups
    near = False
    for last in [False] * 19 + [True]:
        if not (near or last):  # plain sums suffice to come near the modes
            sums, reach = summed(packed, evaluator(theta[:, None, :], modes, layout, order), fits, 1 + G + G * G)
            step = np.linalg.solve(sums[:, 1 + G :].reshape(fits, G, G) + np.eye(G), (sums[:, 1 : 1 + G] - modes[:, 0])[..., None])[..., 0]
            near = np.max(np.abs(step)) < 1e-3
        else:
            rows = 1 + G + G * (G + 1) // 2
            sums, reach = summed(packed, group_deriver(theta, modes, layout, order), fits, rows * (1 + N + N * N))
            found = [_joined(s.reshape(rows, -1), t, v[0], layout) for s, t, v in zip(sums, theta, modes)]
            values, gradients, hessians, step = (np.array(x) for x in zip(*found))
            done = np.max(np.abs(step)) < 1e-6
            if done or last:  # group modes not found: no fit counts as converged
                return values, gradients, hessians, reach if done else np.full(fits, np.inf), modes + np.clip(step, -2, 2)[:, None]
        modes = modes + np.clip(step, -2, 2)[:, None]


def _joined(rows, theta, v, layout):
    """Laplace value of one fit, its gradient and Hessian in the parameters, and the Newton step of the group modes ``v``.

    ``rows`` are the sums of ``Batch.group_jets``, in parameters and group levels; a group's level is its mode times the spread.
    """
    P, G = len(theta), len(v)
    N, at = P + G, layout.at("sd_group")
    spread = 0.0 if at is None else abs(theta[at])
    first, second = rows[:, 1 : 1 + N], rows[:, 1 + N :].reshape(-1, N, N)
    inner = np.eye(N)  # levels and parameters in modes and parameters
    inner[P:, P:] *= spread
    h = np.swapaxes(inner, 0, 1) @ second @ inner
    if at is not None:
        inner[P:, at] = v
        h = np.swapaxes(inner, 0, 1) @ second @ inner
        for g in range(G):
            h[:, at, P + g] += first[:, P + g]
            h[:, P + g, at] += first[:, P + g]
    sums = Jet(rows[:, 0], (first @ inner).T, np.moveaxis(h, 0, -1))
    s = Jet.constant(np.array(spread), N) if at is None else Jet.variable(np.array(spread), at, N)
    own = [Jet.variable(np.array(x), P + g, N) for g, x in enumerate(v)]
    score = [s * sums[1 + g] - own[g] for g in range(G)]
    slot = group_slots(G)
    curvature = [[s * s * sums[slot[g, k]] + float(g == k) for k in range(G)] for g in range(G)]
    S, S1, S2 = (np.array([[getattr(c, part) for c in row] for row in curvature]) for part in "vgh")
    inverse = np.linalg.inv(S)
    turned = np.einsum("ij,jkn->ikn", inverse, S1)
    logdet = Jet(np.linalg.slogdet(S)[1], np.einsum("iin->n", turned), np.einsum("ij,jinm->nm", inverse, S2) - np.einsum("ijn,jim->nm", turned, turned))
    total = sums[0] - 0.5 * logdet
    for x in own:
        total = total - 0.5 * (x * x)
    q, q1, q2 = (np.array([getattr(x, part) for x in score]) for part in "vgh")
    step = np.linalg.solve(S, q)
    path = np.concatenate((np.eye(P), -np.linalg.solve(q1[:, P:], q1[:, :P])))  # the modes follow the parameters
    bend = -np.linalg.solve(q1[:, P:], (path.T @ q2 @ path).reshape(G, -1)).reshape(G, P, P)
    hessian = path.T @ total.h @ path + np.einsum("g,gij->ij", total.g[P:], bend)
    return total.v + q @ step / 2, total.g @ path, hessian, step


def _stencil(P, h=2e-3):
    """Offsets for central first and all second differences."""
    rows = [np.zeros(P)]
    for i in range(P):
        for sign in (1, -1):
            rows.append(sign * h * np.eye(P)[i])
    for i in range(P):
        for j in range(i):
            for sign in (1, -1):
                rows.append(sign * h * (np.eye(P)[i] + np.eye(P)[j]))
    return np.array(rows)


def _differences(values, P, h=2e-3):
    """Gradient (P,) and Hessian (P, P) from values at the stencil's points."""
    base, up, down = values[0], values[1 : 2 * P + 1 : 2], values[2 : 2 * P + 2 : 2]
    gradient = (up - down) / (2 * h)
    hessian = np.diag((up - 2 * base + down) / h**2)
    at = 2 * P + 1
    for i in range(P):
        for j in range(i):
            pair = values[at] + values[at + 1]
            hessian[i, j] = hessian[j, i] = (pair - up[i] - down[i] - up[j] - down[j] + 2 * base) / (2 * h**2)
            at += 2
    return gradient, hessian


def _newton_step(gradient, hessian, limit):
    """Ascent step; directions of wrong or vanishing curvature are turned and damped."""
    roots, vectors = np.linalg.eigh(-hessian)
    floor = 1e-6 * max(1.0, np.max(np.abs(roots)))
    step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(roots), floor))
    return step * min(1.0, limit / max(np.max(np.abs(step)), 1e-300))


class Climb:
    """Newton ascent of several fits on one expansion; a fit whose value drops retries a shorter step."""

    def __init__(self, theta, spread_at):
        self.theta, self.spread_at = theta.copy(), spread_at
        self.step = np.zeros_like(theta)
        self.value = np.full(len(theta), -np.inf)
        self.gradient, self.hessian = np.zeros_like(theta), np.zeros((*theta.shape, theta.shape[1]))
        self.decrement = np.full(len(theta), np.inf)

    def trial(self):
        """Accepted points plus their untried step; a spread's sign does not matter, so it stays positive."""
        out = self.theta + self.step
        out[:, self.spread_at] = np.abs(out[:, self.spread_at])
        return out

    def update(self, values, gradients, hessians, active):
        """Takes what was found at the trial points; returns which fits accepted them."""
        trial = self.trial()
        fresh = active & (values >= self.value - 1e-10 * np.abs(values))
        for f in np.flatnonzero(active):
            if not fresh[f]:
                self.step[f] /= 4
                continue
            self.theta[f], self.value[f], self.gradient[f], self.hessian[f] = trial[f], values[f], gradients[f], hessians[f]
            self.step[f] = _newton_step(gradients[f], hessians[f], 0.7)
            self.decrement[f] = abs(gradients[f] @ self.step[f])
        return fresh

    def back_up(self, best, exact):
        """Fits that a re-expansion shows to be worse than before go half way back instead."""
        for f in np.flatnonzero(exact):
            if self.value[f] < best.value[f] - 1e-8 * abs(best.value[f]):
                self.step[f] = (best.theta[f] - self.theta[f]) / 2
                self.decrement[f] = np.inf
            else:
                best.theta[f], best.value[f] = self.theta[f].copy(), self.value[f]


class Best:
    """Best parameters so far by exact value (taken right after an expansion)."""

    def __init__(self, theta):
        self.theta, self.value = theta.copy(), np.full(len(theta), -np.inf)


def fit_mixed(cells, form, weight="n_known", wins="wins", start=None, partial=False, draw=None):
    """Fits the model ``form`` and returns its result tables.

    A fit has converged when its Newton decrement vanishes at the centre of its sums; it then leaves the
    passes. One that has not raises, unless ``partial`` is set: then ``fit_stats`` tells which have.

    ``cells`` with a ``fit`` column (0..F-1) hold F data sets that are fitted side by side in the
    same passes. ``start`` is a parameter vector of an earlier fit of the same form (see
    ``MixedFit.spreads['theta']``). ``draw`` = (F, function) makes F data sets of one: the function maps
    (rows, layout, numbers of the data sets) to rows with ``fit`` and new ``wins``, in each pass anew, so that
    no table of all of them is written; it must be repeatable.
    """
    spark = cells.sparkSession
    rows, groups, scales, level, sizes = prepare(cells, form, weight, wins)
    if draw:
        sizes = np.repeat(sizes, draw[0])
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "entity", "place", "x")
    fits = len(sizes)
    layout = form.layout(len(groups))
    P = len(layout.names)
    theta = np.zeros((fits, P))
    theta[:, layout.at("intercept")] = level
    spread_at = [i for i, name in enumerate(layout.names) if name.startswith("sd_")]
    theta[:, spread_at] = 0.4
    if start is not None:
        theta[:] = start
    state = materialise(start_state(rows, theta[0], layout, draw and fits), "state")
    size = state.count()
    group_modes = np.zeros((fits, 1, len(groups))) if form.group_random else None
    packed, expansions, ended = None, 0, []
    best = Best(theta)
    active, converged = sizes > 0, np.zeros(fits, bool)
    value, hessian = np.zeros(fits), np.zeros((fits, P, P))

    def modes_of(which):
        """Rows of the modes of some fits, from the sums at hand."""
        return _of(packed, which, fits).mapInArrow(mode_emitter(theta[:, None, :], group_modes, layout, order), STATE)

    while True:
        if packed is not None:
            state = modes_of(active)
        order = 2 if expansions < 2 and start is None else 4
        mine = draw[1](rows, layout, np.flatnonzero(active).tolist()) if draw else _of(rows, active, fits)
        packed = expand(mine, state, int(size * active.sum() // fits))
        expansions += 1
        climb = Climb(theta, spread_at)
        for inner in range(1 if order == 2 else 4):
            values, gradients, hessians, reach, modes = _derive(packed, climb.trial(), group_modes, layout, order)
            accepted = climb.update(values, gradients, hessians, active)
            if modes is not None:
                group_modes = np.where(accepted[:, None, None], modes, group_modes)
            if inner == 0 and order == 4:
                # the sums are exact at their centre, where these points' modes are
                climb.back_up(best, active & (reach < 0.3))
                done = active & accepted & (reach < NEAR) & (climb.decrement < DECREMENT)
                value[done], hessian[done], theta[done] = climb.value[done], climb.hessian[done], climb.theta[done]
                if done.any():
                    ended.append(modes_of(done))
                converged, active = converged | done, active & ~done
            if (climb.decrement[active] < DECREMENT).all():
                break
        theta[active] = climb.trial()[active]
        if not active.any() or expansions == MAX_EXPANSIONS:
            break
    if not partial and active.any():
        raise RuntimeError(f"{active.sum()} of {fits} fits have not converged in {expansions} passes")
    if active.any():
        value[active], hessian[active] = climb.value[active], climb.hessian[active]
        ended.append(modes_of(active))
    state = ended[0]
    for more in ended[1:]:
        state = state.unionAll(more)
    state = materialise(state, "modes")
    return _report(spark, form, layout, groups, scales, theta, value, hessian, state, group_modes, converged, expansions, sizes)


def _of(rows, which, fits):
    """Rows of the marked fits; there are at most as many numbers as fits."""
    return rows if which.all() else rows.where(F.col("fit").isin(np.flatnonzero(which).tolist()))


def _report(spark, form, layout, groups, scales, theta, values, hessians, state, group_modes, converged, expansions, sizes):
    """Result tables on the original scale of the predictors."""
    names = layout.names
    fixed_names = [n for n in names if not n.startswith("sd_")]
    label = {"intercept": "(Intercept)", "x": form.x, "m": form.m}
    label.update({f"group{g}": f"group_name{groups[g]}" for g in range(len(groups))})
    back = np.eye(len(fixed_names))
    back[fixed_names.index("x")] /= scales["x"]
    if form.m:
        at = fixed_names.index("m")
        back[at] /= scales["m"]
        back[0] = back[0] - scales["m_mean"] * back[at]
    sd_terms = [
        ("sd_intercept", "entity", "(Intercept)", 1.0), ("sd_slope", "entity", form.x, 1 / scales["x"]),
        ("sd_nested", "entity:group", "(Intercept)", 1.0), ("sd_group", "group", "(Intercept)", 1.0),
    ]
    fits = len(sizes)
    entities = {r["fit"]: r["n"] for r in state.groupBy("fit").agg(F.countDistinct("entity").alias("n")).collect()}
    coefficient_rows, spread_rows, stat_rows = [], [], []
    fixed, spreads, covariances = {}, {"theta": theta}, {}
    p = len(fixed_names)
    for f in range(fits):
        hessian = hessians[f]
        sds = {n: float(theta[f, layout.at(n)]) for n, *_ in sd_terms if layout.at(n) is not None}
        free = list(range(p)) + [layout.at(n) for n in sds if sds[n] >= SINGULAR]
        covariance = np.linalg.pinv(-hessian[np.ix_(free, free)])[:p, :p]
        beta = back @ theta[f, :p]
        covariance = back @ covariance @ back.T
        covariances[f] = [label[name] for name in fixed_names], covariance
        errors = np.sqrt(np.maximum(np.diag(covariance), 0))
        for i, name in enumerate(fixed_names):
            coefficient_rows.append((f, label[name], float(beta[i]), float(errors[i])))
            fixed[(f, label[name])] = float(beta[i])
        for name, factor, term, scale in sd_terms:
            if name in sds:
                spread_rows.append((f, factor, term, sds[name] * scale, (sds[name] * scale) ** 2))
                spreads[(f, factor, term)] = sds[name] * scale
        loglik = float(values[f])
        k = p + len(sds)
        n = sizes[f]
        stat_rows.append((f, int(n), int(entities[f]), len(groups), loglik, 2 * k - 2 * loglik,
                          k * math.log(n) - 2 * loglik, bool(min(sds.values()) < SINGULAR) if sds else False,
                          bool(converged[f]), expansions))
    coefficients = spark.createDataFrame(coefficient_rows, "fit int, term string, estimate double, std_error double")
    coefficients = coefficients.withColumn("statistic", F.try_divide("estimate", "std_error")).withColumn(
        "p_value", F.expr(two_sided("statistic")))
    components = spark.createDataFrame(spread_rows, "fit int, factor string, term string, sd double, variance double")
    stats = spark.createDataFrame(
        stat_rows, "fit int, n_obs long, n_entities long, n_groups int, log_lik double, aic double, bic double, "
        "is_singular boolean, converged boolean, expansions int")
    return MixedFit(coefficients, _effects(spark, form, layout, groups, scales, state, theta, group_modes, fits),
                    components, stats, fixed, spreads, covariances)


def _effects(spark, form, layout, groups, scales, state, theta, group_modes, fits):
    """(fit, factor, level, group_name, term, cond_mode) of all random terms; one row per level and term."""
    name = F.get(F.array(*[F.lit(g) for g in groups]), F.col("place"))
    once = state.groupBy("fit", "entity").agg(
        F.max("intercept_mode").alias("i"), (F.max("slope_mode") / scales["x"]).alias("s"))
    tables = []
    if form.entity_intercept:
        tables.append(once.select("fit", F.lit("entity").alias("factor"), F.col("entity").alias("level"),
                                  F.lit("(Intercept)").alias("term"), F.col("i").alias("cond_mode")))
    if form.entity_slope:
        tables.append(once.select("fit", F.lit("entity").alias("factor"), F.col("entity").alias("level"),
                                  F.lit(form.x).alias("term"), F.col("s").alias("cond_mode")))
    if form.nested:
        tables.append(state.select("fit", F.lit("entity:group").alias("factor"),
                                   F.concat("entity", F.lit(":"), name).alias("level"),
                                   F.lit("(Intercept)").alias("term"), F.col("nested_mode").alias("cond_mode")))
    if form.group_random:
        sd = theta[:, layout.at("sd_group")]
        rows = [(f, "group", g, "(Intercept)", float(sd[f] * group_modes[f, 0, i]))
                for f in range(fits) for i, g in enumerate(groups)]
        tables.append(spark.createDataFrame(rows, "fit int, factor string, level string, term string, cond_mode double"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
