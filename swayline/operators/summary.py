"""Per-entity summaries."""

from pyspark.sql import functions as F

from swayline.operators.quantiles import cell_quantiles, value_cells
from swayline.scratch import materialise
from swayline.skew import attach


def entity_summary(frame, rename=None):
    """(entity, mean, median, max, min of the metric, n_contests); best mean first.

    The rows are merged once into (entity, value) counts; all five statistics come from those.
    ``rename`` maps raw entity names to final ones; it is applied to the merged counts, so its
    string work is done once per name and value instead of once per row.
    """
    cells = value_cells(frame, ["entity"], "metric")
    if rename is not None:
        cells = value_cells(rename(cells), ["entity"], "metric", "n")
    cells = materialise(cells, "cells")
    base = cells.groupBy("entity").agg(
        (F.sum(F.col("metric") * F.col("n")) / F.sum("n")).alias("mean_metric"),
        F.max("metric").alias("max_metric"),
        F.min("metric").alias("min_metric"),
        F.sum("n").alias("n_contests"),
    )
    medians = cell_quantiles(cells, ["entity"], "metric", [0.5]).withColumnRenamed("q0", "median_metric")
    joined = base.join(medians, "entity", "left")
    return joined.select(
        "entity", "mean_metric", "median_metric", "max_metric", "min_metric", "n_contests"
    ).orderBy(F.desc_nulls_last("mean_metric"), "entity")


def metric_by_outcome(frame, entity=None):
    """Mean metric in wins and in losses, of one entity or of all."""
    rows = frame if entity is None else frame.where(F.col("entity") == entity)
    return rows.groupBy("entity", "outcome").agg(
        F.avg("metric").alias("mean_metric"), F.count(F.lit(1)).alias("n")
    )


def entity_groups(frame):
    """Distinct (entity, group_name) with the group's latest date for that entity."""
    return frame.groupBy("entity", "group_name").agg(F.max("date").alias("last_date"))


def current_group(frame):
    """Group of the entity's latest observation."""
    latest = F.struct("date", "game", "group_name")
    return frame.groupBy("entity").agg(F.max_by("group_name", latest).alias("current_group"))


def with_current_group(frame):
    """Every (entity, group_name) and whether the group is the entity's current one."""
    groups = materialise(entity_groups(frame), "groups")
    now = attach(groups, current_group(frame).withColumn("n", F.lit(1)), ["entity"]).drop("n")
    return now.withColumn("is_current", F.col("group_name") == F.col("current_group"))
