"""Parametric bootstrap of the entities' total slopes."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.functions.draws import binomial, standard_normal
from swayline.functions.replicates import COLUMNS, replicate_deriver, replicate_slopes, summariser
from swayline.operators.effects import entity_effects
from swayline.operators.mixed import DECREMENT, NEAR, Climb, prepare, summed
from swayline.scratch import materialise

#: Drawn cells (a cell of one replicate) that a group of an entity and a block of replicates holds, and a task works on.
GROUP_CELLS, TASK_CELLS = 1 << 20, 1 << 24
#: Newton steps after which replicates count as not converged.
MAX_STEPS = 200


def normal(tag, term, fit):
    """Normal draw of an entity's term in a replicate."""
    return standard_normal(tag, F.lit(term), fit, F.col("entity"))


def cell_key(tag, fit):
    """Key of the outcomes of a cell in a replicate; tasks make it from the hash of its first three columns."""
    return F.xxhash64(tag, fit, "entity", "place", "x")


def drawer(theta, seed):
    """Function of (rows, layout, numbers) that draws the outcomes of replicates anew, random effects included.

    ``theta`` are the parameters of the model that is simulated. A replicate's effect of an entity and its
    wins in a cell are drawn from hashes of their keys, so a repeated task or pass draws the same values.
    """

    def draw(rows, layout, numbers):
        def value(name):
            at = layout.at(name)
            return F.lit(0.0 if at is None else float(theta[at]))

        tag, group = F.lit(seed), F.get(F.array(*[value(f"group{g}") for g in range(layout.groups)]), F.col("place"))
        copies = rows.drop("fit", "wins").withColumn("fit", F.explode(F.lit(numbers)))
        slope = value("x") + value("sd_slope") * normal(tag, "slope", F.col("fit"))
        level = value("intercept") + group + value("m") * F.col("m") + value("sd_intercept") * normal(tag, "level", F.col("fit"))
        p = 1 / (1 + F.exp(-(level + slope * F.col("x"))))
        return copies.withColumn("wins", binomial(F.col("n"), p, cell_key(tag, F.col("fit"))))

    return draw


def ready(cells, numbers, seed, layout, tasks):
    """``COLUMNS`` of every cell, whole (entity, block) groups side by side, with what the draws of the replicates ``numbers`` start from.

    Only the cells are shuffled. Draws, which are as many as cells times replicates, are made in the task that uses them.
    """
    tag, entity = F.lit(seed), W.partitionBy("entity", "block").orderBy("place", "x")
    dealt = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(tasks, "entity", "block")
    first = dealt.withColumn("first", F.row_number().over(entity) == 1)
    every = F.lit(numbers).cast("array<int>")
    fits = F.when(F.col("blocks") == 1, every).otherwise(F.filter(every, lambda f: f % F.col("blocks") == F.col("block")))

    def draws(term):
        if layout.at(f"sd_{'intercept' if term == 'level' else term}") is None:
            return F.lit(None).cast("array<double>")
        return F.when(F.col("first"), F.transform(fits, lambda f: normal(tag, term, f)))

    seeds = F.when(F.col("first"), F.transform(fits, lambda f: F.xxhash64(tag, f, "entity")))
    return first.withColumns({"seeds": seeds} | {f"{term}_draws": draws(term) for term in ("slope", "level")}).select(*COLUMNS)


def bootstrap_slopes(cells, fit, form, replicates=1000, seed=123, levels=(0.025, 0.975)):
    """Mean, standard error and percentile interval of each entity's total slope, with the estimate.

    ``fit`` is the fit of ``form`` to ``cells``. All replicates are fitted side by side in the same passes, each by
    Newton steps from exact derivatives; those that have converged leave them. A pass deals the cells by entity and
    draws outcomes in the tasks, so that what is shuffled or written does not grow with the replicates; an entity with
    very many cells is dealt as blocks of replicates. An entity's summary sees one value per replicate whose refit
    converged; ``n_boot`` tells how many those are.
    """
    if form.group_random or form.nested:
        raise ValueError("replicates are drawn for entity terms only")
    spark = cells.sparkSession
    truth = np.asarray(fit.spreads["theta"][0])
    rows, groups, scales, *_ = prepare(cells, form)
    layout = form.layout(len(groups))
    counts = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("cells"))
    blocks = F.least(F.lit(replicates), F.ceil(F.col("cells") * F.lit(replicates) / F.lit(GROUP_CELLS))).cast("int").alias("blocks")
    rows = rows.join(counts.select("entity", blocks), "entity").select("entity", "place", "m", "x", "n", "blocks")
    rows = materialise(rows, "cells")
    size = rows.count()

    def tasks(fits):
        cores = spark.sparkContext.defaultParallelism
        return cores * max(1, -(-size * fits // TASK_CELLS // cores))

    theta = np.tile(truth, (replicates, 1))
    climb = Climb(theta, [i for i, name in enumerate(layout.names) if name.startswith("sd_")])
    active, converged, P = np.ones(replicates, bool), np.zeros(replicates, bool), theta.shape[1]
    for _ in range(MAX_STEPS):
        numbers, points = np.flatnonzero(active), climb.trial()
        drawn = ready(rows, numbers.tolist(), seed, layout, tasks(len(numbers)))
        sums, reach = summed(drawn, replicate_deriver(points, numbers, truth, layout), replicates, 1 + P + P * P)
        accepted = climb.update(sums[:, 0], sums[:, 1 : 1 + P], sums[:, 1 + P :].reshape(-1, P, P), active)
        done = active & accepted & (reach < NEAR) & (climb.decrement < DECREMENT)
        converged, active = converged | done, active & ~done
        if not active.any():
            break
    numbers = np.flatnonzero(converged)
    drawn = ready(rows, numbers.tolist(), seed, layout, tasks(len(numbers))) if len(numbers) else rows.limit(0).select(
        *[F.lit(None).alias(c) if c not in rows.columns else c for c in COLUMNS])
    slopes = drawn.mapInArrow(replicate_slopes(climb.theta, numbers, truth, layout, scales["x"]), "entity string, slopes array<double>")
    summary = slopes.groupBy("entity").applyInArrow(
        summariser(levels), "entity string, mean_boot double, se_boot double, ci_lower double, ci_upper double, n_boot long")
    original = entity_effects(fit, form).select("entity", "total_slope")
    return summary.join(original, "entity", "left").orderBy(F.desc_nulls_last("total_slope"), "entity")
