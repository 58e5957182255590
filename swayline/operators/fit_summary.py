"""Summary of a fitted mixed model: correlations of its fixed effects and quantiles of its scaled residuals."""

import numpy as np
from pyspark.sql import functions as F

from swayline.operators.effects import entity_effects
from swayline.operators.quantiles import cell_quantiles
from swayline.scratch import materialise
from swayline.skew import attach

QUANTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def fixed_correlations(spark, fit, number=0):
    """(term, other, value) for each two fixed effects; NULL where one has no error."""
    terms, covariance = fit.covariance[number]
    errors = np.sqrt(np.maximum(np.diag(covariance), 0))
    rows = []
    for j in range(len(terms)):
        for i in range(j):
            both = errors[i] * errors[j]
            rows.append((terms[j], terms[i], float(covariance[i, j] / both) if both > 0 else None))
    return spark.createDataFrame(rows, "term string, other string, value double")


def residual_cells(cells, fit, form, weight="n_known", wins="wins"):
    """(fit, residual, n): scaled residuals of single outcomes around the conditional means, equal ones merged.

    A win at the linear predictor eta has exp(-eta / 2), a loss -exp(eta / 2), which is the distance of the
    outcome from its probability over its standard deviation. Incomplete rows are left out, as in the fit.
    """
    m = F.col(form.m) if form.m else F.lit(0.0)
    rows = cells.select(
        "entity", "group_name", F.col(form.x).cast("double").alias("x"), m.cast("double").alias("m"),
        F.col(weight).cast("long").alias("n"), F.col(wins).cast("long").alias("wins"),
    ).where("n > 0 and entity is not null and group_name is not null and x is not null and m is not null")
    fixed = {term: value for (number, term), value in fit.fixed.items() if number == 0}
    level = F.lit(fixed["(Intercept)"]) + F.lit(fixed.get(form.m, 0.0)) * F.col("m")
    offsets = {t.removeprefix("group_name"): v for t, v in fixed.items() if t.startswith("group_name")}
    random = fit.random_effects.where("fit = 0")
    if form.group_random:  # one row for each group
        offsets = {r["level"]: r["cond_mode"] for r in random.where("factor = 'group'").collect()}
    if offsets:
        pairs = [F.lit(v) for item in offsets.items() for v in item]
        level = level + F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("group_name")), F.lit(0.0))
    slope = F.lit(fixed[form.x])
    sizes = rows.groupBy("entity", "group_name").agg(F.count(F.lit(1)).alias("rows"))
    if form.entity_intercept or form.entity_slope:
        own = entity_effects(fit, form).where("fit = 0").select(
            "entity", F.col("intercept").alias("own_level"), F.col("slope").alias("own_slope"))
        per_entity = sizes.groupBy("entity").agg(F.sum("rows").alias("rows"))
        rows = attach(rows, own.join(per_entity, "entity"), ["entity"], rows="rows").drop("rows")
        level, slope = level + F.col("own_level"), slope + F.col("own_slope")
    if form.nested:
        own = random.where("factor = 'entity:group'").select(F.col("level").alias("pair"), F.col("cond_mode").alias("own_pair"))
        named = sizes.withColumn("pair", F.concat("entity", F.lit(":"), "group_name")).join(own, "pair").drop("pair")
        rows = attach(rows, named, ["entity", "group_name"], rows="rows").drop("rows")
        level = level + F.col("own_pair")
    half = (level + slope * F.col("x")) / 2
    both = F.array(
        F.struct(F.exp(-half).alias("residual"), F.col("wins").alias("n")),
        F.struct((-F.exp(half)).alias("residual"), (F.col("n") - F.col("wins")).alias("n")))
    single = rows.select(F.inline(both)).where("n > 0")
    return single.groupBy(F.lit(0).alias("fit"), "residual").agg(F.sum("n").alias("n"))


def fit_summary(cells, fit, form, weight="n_known", wins="wins"):
    """(part, term, other, value): correlations of the fixed effects, then minimum, quartiles and maximum of the residuals."""
    found = cell_quantiles(
        materialise(residual_cells(cells, fit, form, weight, wins), "residuals"), ["fit"], "residual", list(QUANTILES.values()))
    names = ", ".join(f"'{name}', q{i}" for i, name in enumerate(QUANTILES))
    residuals = found.selectExpr(
        "'residual' AS part", f"stack({len(QUANTILES)}, {names}) AS (term, value)", "cast(NULL AS string) AS other")
    correlations = fixed_correlations(cells.sparkSession, fit).select(F.lit("correlation").alias("part"), "*")
    return correlations.unionByName(residuals)
