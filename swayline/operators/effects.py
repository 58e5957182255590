"""Per-entity effects of a fitted mixed model, and tables built from them."""

from pyspark.sql import functions as F

from swayline.operators.ranking import first_k, one_group, ranked, top_with_ties


def entity_effects(fit, form):
    """(fit, entity, intercept, slope, total_slope, total_intercept, total_effect) of the entity terms.

    Totals add the fixed effect to the conditional mode. Terms a model lacks count as zero.
    """
    def mode(term):
        return F.coalesce(F.max(F.when(F.col("term") == term, F.col("cond_mode"))), F.lit(0.0))

    wide = fit.random_effects.where(F.col("factor") == "entity").groupBy("fit", F.col("level").alias("entity")).agg(
        mode("(Intercept)").alias("intercept"), mode(form.x).alias("slope"))

    fixed = fit.coefficients.where(F.col("term").isin(form.x, "(Intercept)")).groupBy(F.col("fit").alias("__fit")).agg(
        F.max(F.when(F.col("term") == form.x, F.col("estimate"))).alias("__x"),
        F.max(F.when(F.col("term") == "(Intercept)", F.col("estimate"))).alias("__level"))
    totals = wide.join(F.broadcast(fixed), F.col("fit") == F.col("__fit")).withColumns({  # one short row per fit
        "total_slope": F.col("slope") + F.col("__x"),
        "total_intercept": F.col("intercept") + F.col("__level"),
    }).drop("__fit", "__x", "__level")
    return totals.withColumn("total_effect", F.col("total_intercept") + F.col("total_slope"))


def with_groups(effects, entity_groups):
    """One row per entity and group it has played for."""
    return effects.join(entity_groups.select("entity", "group_name").distinct(), "entity", "left")


def with_counts(effects, counts):
    """Adds how many recent observations each entity has."""
    return effects.join(counts.select("entity", "n_games"), "entity", "left")


def group_relative(effects):
    """Intercept relative to the group's mean, and slope plus that: the effect inside the group."""
    means = effects.groupBy("group_name").agg(F.avg("total_intercept").alias("group_mean_intercept"))
    joined = effects.join(means, "group_name", "left")
    return joined.withColumn("intercept_std", F.col("total_intercept") - F.col("group_mean_intercept")).withColumn(
        "total_effect", F.col("total_slope") + F.col("intercept_std"))


def top_slopes(effects, k=3):
    """Largest slopes per group, ties kept."""
    return top_with_ties(effects, "group_name", "total_slope", k)


def top_effects(effects, k=3):
    """First k per group by total effect."""
    return first_k(effects, "group_name", "total_effect", k)


def group_table(effects, group, n=None):
    """One group's entities, largest total effect first."""
    return one_group(effects, group, "total_effect", n)


def slope_ranking(effects, n=None):
    return ranked(effects, "total_slope", n=n)


def predict_grid(effects, fit, form, group, grid, m=0.0):
    """Win probability of every entity of one group along ``grid`` values of the predictor."""
    fixed = {t: v for (f, t), v in fit.fixed.items() if f == 0}
    level = fixed.get(f"group_name{group}", 0.0) + fixed.get(form.m, 0.0) * m
    return predict_lines(effects, group, grid, level)


def predict_lines(effects, group, grid, level=0.0):
    """The same for any table of lines; ``level`` is added to their intercepts."""
    points = effects.where(F.col("group_name") == group).withColumn(
        "x", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    eta = F.col("total_intercept") + F.lit(level) + F.col("total_slope") * F.col("x")
    return points.select("entity", "group_name", "x", (1 / (1 + F.exp(-eta))).alias("probability"))
