"""Probit regressions of the outcome on the metric, one line per entity."""

import numpy as np
from pyspark.sql import functions as F

from swayline.functions import normal
from swayline.functions.blocks import eliminator, pull_of, reporter, stepper
from swayline.operators.linear import contrast_terms, level_key
from swayline.operators.moments import moments
from swayline.scratch import materialise
from swayline.skew import attach

TOLERANCE = 1e-9
#: Newton decrement of the whole-data model at convergence: estimates are then within 1e-7 standard errors.
DECREMENT = 1e-14
#: Newton steps after which a fit counts as not converged: a line is NULL then, the whole-data model an error.
MAX_STEPS = 200
#: (entity, group) pairs that a task packs, where there are more than a task for each core.
PAIRS_PER_TASK = 50_000


def _cells(cells, keys, weight, wins):
    rows = cells.where(F.col(weight) > 0).groupBy(*keys, "metric").agg(
        F.sum(weight).cast("double").alias("trials"), F.sum(wins).alias("wins")
    )
    return materialise(rows.where("metric is not null"), "probit")


def separation(rows, keys):
    """Per key: spread of the metric, and whether a threshold on it splits wins from losses.

    A split, or a single kind of outcome, drives the estimates to infinity, so such entities
    are reported as ``separated`` instead of being given a number.
    """
    won, lost = F.when(F.col("wins") > 0, F.col("metric")), F.when(F.col("wins") < F.col("trials"), F.col("metric"))
    ends = rows.groupBy(*keys).agg(
        F.min(won).alias("w0"), F.max(won).alias("w1"), F.min(lost).alias("l0"), F.max(lost).alias("l1"),
        F.min("metric").alias("lo"), F.max("metric").alias("hi"),
    )
    split = F.col("w0").isNull() | F.col("l0").isNull() | (F.col("l1") <= F.col("w0")) | (F.col("w1") <= F.col("l0"))
    return ends.select(*keys, (F.col("lo") < F.col("hi")).alias("spread"), split.alias("separated"))


def _scaled(rows, keys):
    """Rows of the keys that can be fitted, with the metric scaled per key as x; and all keys' stats."""
    stats = moments(rows, keys, "metric", "trials").join(separation(rows, keys), keys)
    stats = materialise(stats, "keys")
    joined = attach(rows, stats, keys).where("spread and not separated")
    x = (F.col("metric") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    fitted = materialise(joined.select(*keys, x.alias("x"), "trials", "wins").where("x is not null"), "scaled")
    return fitted, stats


def _score_sums(rows, state, keys, size):
    """Per key: score, observed and expected information of a + b * x at the state's a and b.

    The observed information drives the steps, the expected one gives the variances.
    """
    base = attach(rows, state, keys, size=size, scanned=True).selectExpr("*", "a + b * x AS eta").selectExpr("*", "abs(eta) AS far")
    base = base.selectExpr("*", f"greatest({normal.upper_tail('far')}, 1e-300D) AS tail", f"{normal.density('eta')} AS d")
    base = base.selectExpr("*", "d / (CASE WHEN eta > 0 THEN 1 - tail ELSE tail END) AS won",
                           "d / (CASE WHEN eta > 0 THEN tail ELSE 1 - tail END) AS lost")
    base = base.selectExpr(
        "*", "wins * won - (trials - wins) * lost AS s",
        "wins * won * (won + eta) + (trials - wins) * lost * (lost - eta) AS o", "trials * won * lost AS i")
    sums = [f"sum({v}{power}) AS {v}{k}" for v in "soi" for k, power in enumerate(("", " * x", " * x * x"))
            if not (v == "s" and k == 2)]
    return base.groupBy(*keys).agg(*[F.expr(t) for t in ["max(n) AS n", "max(a) AS a", "max(b) AS b", *sums]])


def _start(rows, keys):
    zero = F.lit(0.0)
    start = rows.groupBy(*keys).agg(F.sum("trials").alias("n")).select(*keys, zero.alias("a"), zero.alias("b"), "n")
    return materialise(start, "state")


def entity_probits(cells, weight="n_known", wins="wins"):
    """One probit line per (group_name, entity) by grouped Newton steps over all entities at once."""
    keys = ["group_name", "entity"]
    rows, stats = _scaled(_cells(cells, keys, weight, wins), keys)
    state = _start(rows, keys)
    size = state.count()
    for _ in range(MAX_STEPS):
        stepped = _score_sums(rows, state, keys, size).selectExpr(
            "*", "o0 * o2 - o1 * o1 AS det", "i0 * i2 - i1 * i1 AS idet"
        ).selectExpr(
            "*", "try_divide(o2 * s0 - o1 * s1, det) AS da", "try_divide(o0 * s1 - o1 * s0, det) AS db"
        ).selectExpr(
            # least and greatest skip NULL: a step that cannot be computed must stay NULL
            *keys, "a + CASE WHEN da IS NOT NULL THEN greatest(least(da, 1.5D), -1.5D) END AS a",
            "b + CASE WHEN db IS NOT NULL THEN greatest(least(db, 1.5D), -1.5D) END AS b", "n",
            "CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN greatest(abs(da), abs(db)) END AS step", "try_divide(i2, idet) AS vaa", "try_divide(i0, idet) AS vbb",
            "try_divide(-i1, idet) AS vab",
        )
        lines = materialise(stepped, "lines")
        state = lines.select(*keys, "a", "b", "n")
        if (lines.agg(F.max("step")).first()[0] or 0.0) < TOLERANCE:
            break
    shift = F.col("mean") / F.col("sd")
    done = F.col("step") < TOLERANCE
    lines = lines.withColumns({c: F.when(done, F.col(c)) for c in ("a", "b", "vaa", "vbb", "vab")})
    joined = attach(stats.drop("n"), lines.drop("step").withColumnRenamed("n", "trials"), keys, rows="trials")
    return joined.select(
        *keys, (F.col("b") / F.col("sd")).alias("slope"), (F.col("a") - shift * F.col("b")).alias("intercept"),
        (F.col("vbb") / (F.col("sd") * F.col("sd"))).alias("var_slope"),
        (F.col("vaa") + shift * shift * F.col("vbb") - 2 * shift * F.col("vab")).alias("var_intercept"),
        F.col("separated"),
    )


def probit_interaction(cells, weight="n_known", wins="wins", reference=(), collate=None):
    """Coefficients of a probit outcome ~ metric * entity inside every group; for the reference see ``level_key``."""
    lines = materialise(entity_probits(cells, weight, wins), "lines")
    usable = F.when(F.col("slope").isNotNull(), level_key(F.col("entity"), reference, collate))
    line = F.struct("slope", "intercept", "var_slope", "var_intercept")
    groups = lines.groupBy("group_name").agg(F.min(usable)["entity"].alias("reference_entity"), F.min_by(line, usable).alias("ref"))
    joined = lines.join(groups, "group_name").select(
        *lines.columns, "reference_entity", *[F.col(f"ref.{c}").alias(f"ref_{c}") for c in
                                              ("slope", "intercept", "var_slope", "var_intercept")])
    return _with_z(contrast_terms(joined))


def _with_z(terms):
    return terms.withColumn("p_value", F.expr(normal.two_sided("statistic")))


def probit_global(cells, weight="n_known", wins="wins", reference=(), collate=None):
    """Whole-data probit outcome ~ group + metric * entity, with one reference entity for all (see ``level_key``).

    Group dummies come first, so in every set of linked groups that lacks the reference entity
    the last entity's level is not identified: its estimate is NULL and the others are relative
    to it. Slopes and their contrasts do not depend on that. Returns (term_kind, term,
    entity, reference_entity, estimate, std_error, statistic, p_value).
    """
    spark = cells.sparkSession
    groups = [r[0] for r in cells.select("group_name").where("group_name is not null").distinct()
              .orderBy("group_name").collect()]
    place = (F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group_name")) - 1).cast("int")
    merged = _cells(cells.where("group_name is not null"), ["entity", "group_name"], weight, wins)
    by_entity = materialise(
        merged.groupBy("entity", "metric").agg(F.sum("trials").alias("trials"), F.sum("wins").alias("wins")), "entity")
    stats = moments(by_entity, ["entity"], "metric", "trials").join(separation(by_entity, ["entity"]), "entity")
    stats = materialise(stats, "entities")
    x = (F.col("metric") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    rows = attach(merged, stats, ["entity"]).where("spread and not separated").select(
        "entity", place.alias("place"), x.alias("x"), "trials", "wins")
    rows = materialise(rows.where("x is not null"), "scaled")
    keys, G = ["entity", "place"], len(groups)
    state = _start(rows, keys)
    size = state.count()
    gamma = np.zeros(G)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, size // 16), size // PAIRS_PER_TASK)
    flat = F.array(*[F.col(c).cast("double") for c in ("n", "a", "b", "s0", "s1", "o0", "o1", "o2", "i0", "i1", "i2")])
    for _ in range(MAX_STEPS):
        sums = _score_sums(rows, state, keys, size).select("entity", "place", flat.alias("sums"))
        packed = sums.groupBy("entity").agg(F.collect_list(F.struct("place", "sums")).alias("pairs")).select(
            "entity", F.col("pairs.place").alias("places"), F.flatten("pairs.sums").alias("sums"))
        packed = materialise(packed.repartition(tasks, "entity"), "pairs")
        parts = packed.mapInArrow(
            eliminator(G), "system array<double>, right array<double>, expected array<double>, "
            "together array<double>, decrement double"
        ).collect()
        system = sum(np.reshape(r["system"], (G, G)) for r in parts)
        right = sum(np.array(r["right"]) for r in parts)
        step = np.linalg.pinv(system, rcond=1e-10, hermitian=True) @ right
        decrement = sum(r["decrement"] for r in parts) + right @ step
        if decrement < DECREMENT:
            break
        step = np.clip(step, -1.5, 1.5)
        gamma = gamma + step
        state = packed.mapInArrow(stepper(step, 1.5), "entity string, place int, a double, b double, n double")
    else:
        raise RuntimeError(f"the whole-data probit has not converged in {MAX_STEPS} steps")
    together = sum(np.reshape(r["together"], (G, G)) for r in parts) > 0
    expected = sum(np.reshape(r["expected"], (G, G)) for r in parts)
    inverse = np.linalg.pinv(expected, rcond=1e-10, hermitian=True)
    return _global_terms(packed, stats, groups, gamma, inverse, together, level_key(F.col("entity"), reference, collate))


def _level_variance(inverse, pin_own, pin_pull):
    """Variance of a level's distance from the one it is relative to, from columns own, pull and place."""
    def numbers(values):
        return F.array(*[F.lit(float(v)) for v in values])

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)

    apart = F.zip_with("pull", F.get(F.array(*[numbers(p) for p in pin_pull]), F.col("place")), lambda a, b: a - b)
    through = F.transform(F.array(*[numbers(row) for row in inverse]), lambda row: dot(row, apart))
    return F.col("own") + F.get(numbers(pin_own), F.col("place")) + dot(apart, through)


def _linked(together):
    """Component number per group: groups that share entities, directly or through others."""
    G = len(together)
    label = np.arange(G)
    for _ in range(G):
        label = np.array([label[np.flatnonzero(together[g])].min() if together[g].any() else label[g] for g in range(G)])
    return label


def _global_terms(packed, stats, groups, gamma, inverse, together, key):
    G = len(groups)
    spark = packed.sparkSession
    reference = packed.agg(F.min(key)["entity"]).first()[0]
    if reference is None:
        raise ValueError("no entity can be fitted")
    ref_pull = pull_of(packed.where(F.col("entity") == reference).first(), G)
    lines = packed.mapInArrow(
        reporter(inverse, ref_pull, gamma),
        "entity string, level double, slope double, var_slope double, cov_reference double, place int, "
        "own array<double>, pull_level array<double>, pull_slope array<double>",
    )
    shift, own = F.col("mean") / F.col("sd"), F.col("own")
    lines = attach(lines, stats.select("entity", "mean", "sd", "n"), ["entity"])
    lines = materialise(lines.select(
        "entity", "place", (F.col("level") - F.col("mean") / F.col("sd") * F.col("slope")).alias("level"),
        (F.col("slope") / F.col("sd")).alias("slope"), (F.col("var_slope") / (F.col("sd") * F.col("sd"))).alias("var_slope"),
        (F.col("cov_reference") / F.col("sd")).alias("cov_reference"),
        # a level's variance is its own part and what the groups' pull on it adds
        (own[0] - 2 * shift * own[1] + shift * shift * own[2]).alias("own"),
        F.zip_with("pull_level", "pull_slope", lambda a, b: a - shift * b).alias("pull"),
    ), "lines")
    ref = lines.where(F.col("entity") == reference).first()
    ref_sd = stats.where(F.col("entity") == reference).first()["sd"]
    component = _linked(together)
    last = {r["place"]: r["key"] for r in lines.groupBy("place").agg(F.max(key).alias("key")).collect()}
    pinned = {}
    for c in set(component):
        names = [last[g] for g in range(G) if component[g] == c and g in last]
        pinned[c] = max(names)["entity"] if names else None
    pinned[component[ref["place"]]] = reference
    names = [n for n in pinned.values() if n is not None]
    pins = {r["entity"]: r for r in lines.where(F.col("entity").isin(names)).collect()}  # one for each set of linked groups
    pin = [pins.get(pinned[component[g]]) for g in range(G)]
    base = np.array([p["level"] if p else np.nan for p in pin])
    pin_own = np.array([p["own"] if p else np.nan for p in pin])
    pin_pull = np.array([p["pull"] if p else [np.nan] * G for p in pin])
    value, across = gamma + base, np.eye(G) - pin_pull

    def error(direction, extra):
        variance = direction @ inverse @ direction + extra
        return float(np.sqrt(variance)) if np.isfinite(variance) and variance >= 0 else None

    rows = [("intercept", "(Intercept)", None, float(value[0]), error(across[0], pin_own[0])),
            ("metric", "metric", reference, float(ref["slope"]), float(np.sqrt(ref["var_slope"])))]
    rows += [("group", f"group_name{groups[g]}", None, float(value[g] - value[0]),
              error(across[g] - across[0], 0.0 if pin[g] is pin[0] else pin_own[g] + pin_own[0])) for g in range(1, G)]
    schema = "term_kind string, term string, entity string, estimate double, std_error double"
    head = spark.createDataFrame(rows, schema)
    others = lines.where(F.col("entity") != reference)
    offset = F.get(F.array(*[F.lit(float(v)) for v in base]), F.col("place"))
    aliased = F.col("entity").isin([n for n in names if n != reference] or [""])
    main = others.select(
        F.lit("entity").alias("term_kind"), F.concat(F.lit("entity"), "entity").alias("term"), "entity",
        F.when(~aliased, F.col("level") - offset).alias("estimate"), F.when(~aliased, F.sqrt(_level_variance(inverse, pin_own, pin_pull))).alias("std_error"))
    variance = F.col("var_slope") + F.lit(ref["var_slope"]) - 2 * F.col("cov_reference") / F.lit(ref_sd)
    inter = others.select(
        F.lit("interaction").alias("term_kind"), F.concat(F.lit("metric:entity"), "entity").alias("term"), "entity",
        (F.col("slope") - F.lit(ref["slope"])).alias("estimate"), F.sqrt(variance).alias("std_error"))
    left_out = stats.where("separated or not spread").select(
        F.lit("interaction").alias("term_kind"), F.concat(F.lit("metric:entity"), "entity").alias("term"), "entity",
        F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("std_error"))
    terms = head.unionByName(main).unionByName(inter).unionByName(left_out)
    terms = terms.withColumn("reference_entity", F.lit(reference)).withColumn(
        "statistic", F.try_divide("estimate", "std_error"))
    return _with_z(terms)
