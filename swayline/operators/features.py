"""Centred and standardised predictors.

Every builder takes rows, or cells that stand for ``weight`` equal rows each. The two
``recent_*`` builders differ on purpose: one scales over rows, the other over entities
and within entities.
"""

from pyspark.sql import functions as F

from swayline.operators.moments import moments
from swayline.scratch import materialise
from swayline.skew import attach


def outcome_cells(frame):
    """Equal observations merged: (entity, group_name, season, metric, n_rows, n_known, wins).

    Every model here depends on a row only through these columns, so the fits run on the
    cells and give the same result as on the rows. The merge is combined on the map side.
    """
    return frame.groupBy("entity", "group_name", "season", "metric").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("outcome").alias("n_known"),
        F.coalesce(F.sum("outcome"), F.lit(0.0)).alias("wins"),
    )


def centred_frame(frame, weight=None):
    """Adds the entity's mean and each row's distance from it."""
    stats = moments(frame, ["entity"], "metric", weight)
    return attach(frame, stats, ["entity"]).withColumnsRenamed({"mean": "metric_mean"}).withColumn(
        "metric_centred", F.col("metric") - F.col("metric_mean")
    ).drop("n", "sd")


def entity_means_ranked(frame):
    """One mean per entity, largest first."""
    means = frame.groupBy("entity").agg(F.avg("metric").alias("metric_mean"))
    return means.orderBy(F.desc_nulls_last("metric_mean"), "entity")


def entity_checks(frame):
    """Rows, spread and outcome variance per entity, with flags for those a model cannot use."""
    checks = frame.groupBy("entity").agg(
        F.avg("metric").alias("metric_mean"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("metric").alias("sd_metric"),
        F.var_samp("outcome").alias("var_outcome"),
    )
    return checks.withColumns({
        "no_spread": F.coalesce(F.col("sd_metric") < 1e-8, F.lit(True)),
        "no_outcome_variation": F.coalesce(F.col("var_outcome") < 1e-8, F.lit(True)),
    })


def last_seasons(frame, seasons=2):
    """Rows of the latest ``seasons`` seasons; the maximum is a scalar subquery."""
    latest = frame.agg(F.max("season")).scalar()
    return frame.where(F.col("season") >= latest - (seasons - 1))


def scale_rows(frame, columns, weight=None):
    """Adds ``{column}_z`` for each column: z-scores over all rows of the frame."""
    added = {}
    for column in columns:
        row = moments(frame, [], column, weight).first()
        mean, sd = row["mean"], row["sd"]
        z = (F.col(column) - F.lit(mean)) / F.lit(sd) if sd else F.lit(None).cast("double")
        added[f"{column}_z"] = z
    return frame.withColumns(added)


def full_rowz(frame, weight=None):
    """Whole window: centred metric and entity mean, both scaled over rows."""
    centred = materialise(centred_frame(frame, weight), "centred")
    return scale_rows(centred, ["metric_centred", "metric_mean"], weight)


def recent_rowz(frame, min_rows=15, seasons=2, weight=None):
    """Latest seasons of entities with enough rows there; z-scores over the remaining rows.

    Means are those of the whole window, as centring comes before the season filter.
    """
    recent = materialise(last_seasons(materialise(centred_frame(frame, weight), "centred"), seasons), "recent")
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = recent.groupBy("entity").agg(rows.alias("n_games"))
    kept = attach(recent, counts, ["entity"], rows="n_games").where(F.col("n_games") >= min_rows)
    return scale_rows(materialise(kept, "recent"), ["metric_centred", "metric_mean"], weight)


def recent_entityz(frame, min_rows=15, seasons=2, weight=None):
    """Latest seasons; entity means scaled over entities, the metric scaled within its entity."""
    recent = materialise(last_seasons(frame, seasons), "recent")
    stats = materialise(moments(recent, ["entity"], "metric", weight).where(F.col("n") >= min_rows), "entities")
    over = stats.agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd")).first()
    z = (F.col("mean") - F.lit(over["mean"])) / F.lit(over["sd"]) if over["sd"] else F.lit(None).cast("double")
    joined = attach(recent, stats.withColumn("metric_mean_z", z), ["entity"]).where(F.col("n").isNotNull())
    return (
        joined.withColumn("metric_c", F.col("metric") - F.col("mean"))
        .withColumn("metric_c_z", F.try_divide("metric_c", "sd"))
        .withColumnRenamed("n", "n_games")
        .drop("mean", "sd")
    )
