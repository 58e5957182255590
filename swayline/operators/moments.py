"""Counts, means and spreads per key, optionally of weighted rows."""

from pyspark.sql import functions as F

from swayline.skew import attach


def moments(frame, keys, value, weight=None):
    """(keys, n, mean, sd): rows with a value, their mean, sample deviation.

    ``weight`` says how many equal rows one row stands for. The weighted deviation is
    summed around the exact mean in a second pass, so no digits cancel. Both passes
    combine on the map side, so a hot key sends one partial row per task.
    """
    if weight is None:
        return frame.groupBy(*keys).agg(
            F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
        )
    known = frame.where(F.col(value).isNotNull()).select(*keys, value, F.col(weight).alias("__w"))
    means = known.groupBy(*keys).agg(
        F.sum("__w").alias("n"), (F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("mean")
    )
    if not keys:
        row = means.first()
        n, mean = F.lit(row["n"]).cast("long"), F.lit(row["mean"]).cast("double")
        return known.agg(n.alias("n"), mean.alias("mean"), _sd(value, mean, n).alias("sd"))
    return attach(known, means, keys).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), _sd(value, F.col("mean"), F.max("n")).alias("sd")
    )


def _sd(value, mean, n):
    square = F.sum(F.col("__w") * (F.col(value) - mean) * (F.col(value) - mean))
    spread = F.when(F.min(value) == F.max(value), 0.0).otherwise(square / (n - 1))
    return F.sqrt(F.when(n > 1, spread))
