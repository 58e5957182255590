"""Mixed logistic models at given spreads: fixed and random terms maximise the penalised likelihood together.

There is no search over spreads, so a fit is a plain Newton ascent of a concave function and takes a few
passes. Each pass sums score and information per (entity, group) pair, eliminates pair terms and then entity
terms in the same JVM aggregate, and returns one small system over the fixed terms and the group terms
(at most three plus two numbers for each group). The log-likelihood is the Laplace value at the joint maximum.
"""

import numpy as np
from pyspark.sql import functions as F

from swayline.functions.normal import two_sided
from swayline.operators.mixed import MixedFit, prepare
from swayline.scratch import materialise
from swayline.skew import attach

MAX_STEPS = 60
#: Newton decrement (twice the penalised log-likelihood still to be gained) at convergence.
DECREMENT = 1e-16
#: Numbers of the columns that act on every row; group columns follow them.
LEVEL, SLOPE, COVARIATE, FIRST_GROUP = 0, 1, 2, 3
SPREADS = ("sd_intercept", "sd_slope", "sd_nested", "sd_group")


def _used(form):
    flags = (form.entity_intercept, form.entity_slope, form.nested, form.group_random)
    return {name for name, flag in zip(SPREADS, flags) if flag}


def fit_at_spreads(cells, form, spreads, weight="n_known", wins="wins"):
    """Result tables of ``form`` with its standard deviations held at ``spreads``.

    ``spreads`` maps sd_intercept, sd_slope, sd_nested and sd_group, on the scale of the predictors, to positive
    numbers for exactly the terms that the form has. Incomplete rows are left out and equal rows may repeat;
    without any complete row a ValueError is raised. ``std_error`` is the one of the joint penalised fit. A group
    column that no row tells apart from the others stays at zero.
    """
    if set(spreads) != _used(form) or any(not s > 0 for s in spreads.values()):
        raise ValueError(f"positive spreads are needed for {sorted(_used(form))}")
    rows, groups, scales, level, sizes = prepare(cells, form, weight, wins)
    sds = dict(spreads)
    if "sd_slope" in sds:
        sds["sd_slope"] *= scales["x"]
    penalty = {name: 1 / sds[name] ** 2 if name in sds else None for name in SPREADS}
    zero = F.lit(0.0)
    state = rows.groupBy("entity", "place").agg(F.max("m").alias("m"), F.sum("n").alias("n")).select(
        "*", zero.alias("u"), zero.alias("w"), zero.alias("v"))
    state = materialise(state, "state")
    size = state.count()
    width = FIRST_GROUP + len(groups)
    place = np.arange(FIRST_GROUP, width)
    free = [LEVEL, SLOPE] + ([COVARIATE] if form.m else [])
    free += place[1:].tolist() if form.group_fixed else place.tolist() if form.group_random else []
    random = np.isin(np.arange(width), place) & form.group_random
    beta, move, best = np.zeros(width), np.zeros(width), -np.inf
    beta[LEVEL] = level
    kept, kept_beta, share, converged = None, beta, 1.0, False
    for step in range(MAX_STEPS):
        trial = materialise(_entities(rows, state, beta, form, penalty, size), "penalised")
        system, score, extra = _system(trial, width, penalty)
        objective = extra["likelihood"] - extra["roughness"] / 2
        if random.any():
            objective -= penalty["sd_group"] * (beta[random] ** 2).sum() / 2
            score[random] -= penalty["sd_group"] * beta[random]
            system[random, random] += penalty["sd_group"]
        if objective < best - 1e-10 * abs(best):  # too far: a shorter step from the last point that was kept
            share /= 2
            state, beta = _moved(kept, move, share), kept_beta + share * move
            continue
        best, kept, kept_beta, share = objective, trial, beta, 1.0
        inverse = np.zeros((width, width))
        inverse[np.ix_(free, free)] = np.linalg.pinv(system[np.ix_(free, free)], hermitian=True)
        move = inverse @ score
        if score @ move + extra["gain"] < DECREMENT:
            converged = True
            break
        state, beta = _moved(kept, move, 1.0), beta + move
    if not converged:
        raise RuntimeError(f"the penalised fit has not converged in {MAX_STEPS} steps")
    log_det = extra["log_det"]
    if random.any():
        log_det += np.linalg.slogdet(system[np.ix_(random, random)] / penalty["sd_group"])[1]
    return _report(cells.sparkSession, form, groups, scales, kept_beta, inverse, best - log_det / 2, kept, sds, sizes, step + 1)


def _entities(rows, state, beta, form, penalty, size):
    """One row per entity: its own Newton step (e0, e1), inverse information, columns and pairs.

    A pair term is eliminated first: it acts on all rows of its pair alike, so what is left are the sums of a
    pair with less information. An entity has at most as many pairs as there are groups.
    """
    keys = ["entity", "place"]
    joined = attach(
        rows.select(*keys, "x", F.col("n").alias("trials"), "wins"), state.select(*keys, "m", "n", "u", "w", "v"), keys,
        size=size, scanned=True)
    offsets = F.array(*[F.lit(float(b)) for b in beta[FIRST_GROUP:]])
    eta = (F.lit(float(beta[LEVEL])) + float(beta[COVARIATE]) * F.col("m") + F.get(offsets, F.col("place")) + F.col("u") + F.col("v")
           + (float(beta[SLOPE]) + F.col("w")) * F.col("x"))
    pairs = joined.withColumn("eta", eta).selectExpr("*", "1 / (1 + exp(-eta)) AS p").selectExpr(
        "*", "wins - trials * p AS s", "trials * p * (1 - p) AS o").groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("m", "n", "u", "w", "v")],
        F.expr("sum(wins * eta - trials * (greatest(eta, 0D) + log1p(exp(-abs(eta))))) AS likelihood"),
        F.sum("s").alias("s0"), F.expr("sum(s * x) AS s1"),
        F.sum("o").alias("o0"), F.expr("sum(o * x) AS o1"), F.expr("sum(o * x * x) AS o2"))
    nested = penalty["sd_nested"]
    if nested:
        pairs = pairs.selectExpr("*", f"o0 + {nested!r}D AS d", f"s0 - {nested!r}D * v AS gv")
    else:
        pairs = pairs.selectExpr("*", "double('Infinity') AS d", "0D AS gv")  # a term that is not there cannot move
    pairs = pairs.selectExpr(
        "*", "o0 - o0 * o0 / d AS r0", "o1 - o0 * o1 / d AS r1", "o2 - o1 * o1 / d AS r2",
        "s0 - o0 * gv / d AS t0", "s1 - o1 * gv / d AS t1")
    summed = pairs.groupBy("entity").agg(
        *[F.max(c).alias(c) for c in ("m", "u", "w")], *[F.sum(c).alias(c) for c in ("likelihood", "r0", "r1", "r2", "t0", "t1")],
        F.expr(f"sum(ln(d / {nested!r}D))" if nested else "0D").alias("pair_log_det"),
        F.expr("sum(gv * gv / d) AS pair_gain"), F.expr(f"{nested or 0.0!r}D * sum(v * v) AS pair_roughness"),
        F.expr("collect_list(struct(place, n, v, o0, o1, d, gv, r0, r1, t0)) AS pairs"))
    level, slope = penalty["sd_intercept"], penalty["sd_slope"]
    i, s = level or 0.0, slope or 0.0
    summed = summed.selectExpr("*", f"r0 + {i!r}D AS b0", f"r2 + {s!r}D AS b2", f"t0 - {i!r}D * u AS g0", f"t1 - {s!r}D * w AS g1")
    if level and slope:
        inverse, log_det = ("b2 / (b0 * b2 - r1 * r1)", "-r1 / (b0 * b2 - r1 * r1)", "b0 / (b0 * b2 - r1 * r1)"), f"ln((b0 * b2 - r1 * r1) / {i * s!r}D)"
    elif level:
        inverse, log_det = ("1 / b0", "0D", "0D"), f"ln(b0 / {i!r}D)"
    elif slope:
        inverse, log_det = ("0D", "0D", "1 / b2"), f"ln(b2 / {s!r}D)"
    else:
        inverse, log_det = ("0D", "0D", "0D"), "0D"
    columns = f"array(struct({LEVEL} AS i, r0 AS c0, r1 AS c1, t0 AS t), struct({SLOPE} AS i, r1 AS c0, r2 AS c1, t1 AS t)"
    columns += f", struct({COVARIATE} AS i, m * r0 AS c0, m * r1 AS c1, m * t0 AS t))" if form.m else ")"
    if form.group_fixed or form.group_random:
        columns = f"concat({columns}, transform(pairs, q -> struct({FIRST_GROUP} + q.place AS i, q.r0 AS c0, q.r1 AS c1, q.t0 AS t)))"
    with_inverse = summed.selectExpr("*", *[f"{e} AS v{n}" for e, n in zip(inverse, ("00", "01", "11"))], f"{log_det} AS own_log_det")
    return with_inverse.selectExpr(
        "entity", "m", "u", "w", "v00", "v01", "v11", "v00 * g0 + v01 * g1 AS e0", "v01 * g0 + v11 * g1 AS e1", "likelihood",
        "own_log_det + pair_log_det AS log_det", f"pair_roughness + {i!r}D * u * u + {s!r}D * w * w AS roughness",
        "pair_gain + v00 * g0 * g0 + 2 * v01 * g0 * g1 + v11 * g1 * g1 AS gain", f"{columns} AS columns", "pairs")


def _system(entities, width, penalty):
    """Information and score of the columns after elimination, and the whole-data sums; added up in Spark."""
    direct = f"""CASE WHEN a.i = {LEVEL} THEN b.c0 WHEN a.i = {SLOPE} THEN b.c1 WHEN a.i = {COVARIATE} THEN m * b.c0
        WHEN b.i = {LEVEL} THEN a.c0 WHEN b.i = {SLOPE} THEN a.c1 WHEN b.i = {COVARIATE} THEN m * a.c0 WHEN a.i = b.i THEN a.c0 ELSE 0D END"""
    through = "a.c0 * (v00 * b.c0 + v01 * b.c1) + a.c1 * (v01 * b.c0 + v11 * b.c1)"
    names = ["likelihood", "log_det", "roughness", "gain"]
    entries = f"""concat(
        flatten(transform(columns, a -> transform(columns, b -> struct(a.i AS i, b.i AS j, {direct} - ({through}) AS value)))),
        transform(columns, a -> struct(a.i AS i, -1 AS j, a.t - a.c0 * e0 - a.c1 * e1 AS value)),
        array({', '.join(f'struct(-1 AS i, {k} AS j, {name} AS value)' for k, name in enumerate(names))}))"""
    found = entities.selectExpr(f"inline({entries})").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    system, score, extra = np.zeros((width, width)), np.zeros(width), dict.fromkeys(names, 0.0)
    for i, j, value in found:  # at most one row for each two columns
        if i < 0:
            extra[names[j]] = value
        elif j < 0:
            score[i] = value
        else:
            system[i, j] = value
    return system, score, extra


def _moved(entities, move, share):
    """State after ``share`` of the Newton step whose part in the columns is ``move``."""
    moves = "array(" + ", ".join(f"{float(b)!r}D" for b in move) + ")"
    pull = entities.selectExpr(
        "*", f"aggregate(columns, 0D, (z, a) -> z + a.c0 * {moves}[a.i]) AS p0", f"aggregate(columns, 0D, (z, a) -> z + a.c1 * {moves}[a.i]) AS p1")
    stepped = pull.selectExpr("*", "e0 - v00 * p0 - v01 * p1 AS du", "e1 - v01 * p0 - v11 * p1 AS dw")
    each = stepped.selectExpr("entity", "m", "u", "w", "du", "dw", "inline(pairs)")
    change = f"(du + {float(move[LEVEL])!r}D + {float(move[COVARIATE])!r}D * m + {moves}[{FIRST_GROUP} + place])"
    return each.selectExpr(
        "entity", "place", "m", "n", f"u + {share!r}D * du AS u", f"w + {share!r}D * dw AS w",
        f"v + {share!r}D * (gv - o0 * {change} - o1 * (dw + {float(move[SLOPE])!r}D)) / d AS v")


def _report(spark, form, groups, scales, beta, inverse, log_lik, entities, sds, sizes, steps):
    names = {LEVEL: "(Intercept)", SLOPE: form.x}
    back = np.eye(len(beta))
    back[SLOPE] /= scales["x"]
    if form.m:
        names[COVARIATE] = form.m
        back[COVARIATE] /= scales["m"]
        back[LEVEL] -= scales["m_mean"] * back[COVARIATE]
    if form.group_fixed:
        names.update({FIRST_GROUP + k: f"group_name{g}" for k, g in enumerate(groups) if k})
    covariance = back @ inverse @ back.T
    estimates, errors = back @ beta, np.sqrt(np.maximum(np.diag(covariance), 0))
    rows = [(0, name, float(estimates[i]), float(errors[i])) for i, name in names.items()]
    coefficients = spark.createDataFrame(rows, "fit int, term string, estimate double, std_error double").withColumn(
        "statistic", F.try_divide("estimate", "std_error")).withColumn("p_value", F.expr(two_sided("statistic")))
    terms = {"sd_intercept": ("entity", "(Intercept)", 1.0), "sd_slope": ("entity", form.x, 1 / scales["x"]),
             "sd_nested": ("entity:group", "(Intercept)", 1.0), "sd_group": ("group", "(Intercept)", 1.0)}
    spread_rows = [(0, *terms[n][:2], sd * terms[n][2], (sd * terms[n][2]) ** 2) for n, sd in sds.items()]
    components = spark.createDataFrame(spread_rows, "fit int, factor string, term string, sd double, variance double")
    stats = spark.createDataFrame(
        [(0, int(sizes[0]), entities.count(), len(groups), float(log_lik), True, steps)],
        "fit int, n_obs long, n_entities long, n_groups int, log_lik double, converged boolean, expansions int")
    fit = F.lit(0).alias("fit")
    modes = [entities.select(fit, F.lit("entity").alias("factor"), F.col("entity").alias("level"), F.lit(term).alias("term"), mode.alias("cond_mode"))
             for used, term, mode in ((form.entity_intercept, "(Intercept)", F.col("u")), (form.entity_slope, form.x, F.col("w") / scales["x"])) if used]
    if form.nested:
        name = F.get(F.array(*[F.lit(g) for g in groups]), F.col("place"))
        modes.append(entities.selectExpr("entity", "inline(pairs)").select(
            fit, F.lit("entity:group").alias("factor"), F.concat("entity", F.lit(":"), name).alias("level"), F.lit("(Intercept)").alias("term"),
            F.col("v").alias("cond_mode")))
    if form.group_random:
        modes.append(spark.createDataFrame(
            [(0, "group", g, "(Intercept)", float(beta[FIRST_GROUP + k])) for k, g in enumerate(groups)],
            "fit int, factor string, level string, term string, cond_mode double"))
    effects = modes[0]
    for more in modes[1:]:
        effects = effects.unionByName(more)
    return MixedFit(coefficients, effects, components, stats, {(0, r[1]): r[2] for r in rows}, {(0, r[1], r[2]): r[3] for r in spread_rows},
                    {0: (list(names.values()), covariance[np.ix_(list(names), list(names))])})
