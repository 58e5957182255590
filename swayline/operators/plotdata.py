"""Tables behind the figures: labels, densities, histograms."""

import math

from pyspark.sql import functions as F

from swayline.operators.moments import moments
from swayline.operators.quantiles import cell_quantiles, value_cells
from swayline.operators.ranking import flag_first_k, other_unless, with_reverse_order
from swayline.scratch import materialise
from swayline.skew import attach


def label_where(df, rule, column="entity", name="label"):
    """Label text where the rule holds, empty elsewhere."""
    return df.withColumn(name, F.when(rule, F.col(column)).otherwise(""))


def scatter_labels(summary, min_contests=50, high_mean=15, low_mean=7, many=175):
    """Contests against mean metric, labelled at the high end and at the busy low end."""
    kept = summary.where(F.col("n_contests") >= min_contests).select("entity", "n_contests", "mean_metric")
    high = label_where(kept, F.col("mean_metric") > high_mean, name="label_high")
    return label_where(high, (F.col("mean_metric") < low_mean) & (F.col("n_contests") > many), name="label_low")


def mean_sd_labels(checks, high_mean=15, small_sd=5.5, top_mean=16, large_sd=7.6):
    """Mean against spread, with the three label rules as nullable columns."""
    mean, sd = F.col("metric_mean"), F.col("sd_metric")
    return checks.select(
        "entity", "metric_mean", "sd_metric",
        F.when((mean > high_mean) & (sd < small_sd), F.col("entity")).alias("label_steady"),
        F.when(mean > top_mean, F.col("entity")).alias("label_top"),
        F.when(sd > large_sd, F.col("entity")).alias("label_volatile"),
    )


def density(frame, value, keys=(), weight=None, points=512):
    """Gaussian kernel density on ``points`` equal steps over the range of the data, per key.

    Bandwidth: 0.9 * min(sd, IQR / 1.34) * n ** -0.2. Rows are first spread over the two
    nearest grid points (linear binning), so the kernel sum runs over at most ``points`` bins
    per key, whatever the number of rows. A key whose values do not vary has no density: it
    keeps one row, at that value, with a NULL density.
    """
    keys = list(keys)
    if not keys:
        whole = frame.withColumn("__all", F.lit(1))
        return density(whole, value, ["__all"], weight, points).drop("__all")
    cells = materialise(value_cells(frame, keys, value, weight), "cells")
    spread = moments(cells, keys, value, "n")
    quartiles = cell_quantiles(cells, keys, value, [0.25, 0.75])
    ends = cells.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    shape = spread.join(quartiles, keys).join(ends, keys)
    iqr = (F.col("q1") - F.col("q0")) / 1.34
    narrow = F.least("sd", F.when(iqr > 0, iqr))
    shape = shape.select(
        *keys, "n", "lo", ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
        (F.coalesce(narrow, F.col("sd")) * 0.9 * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"),
    )
    flat = shape.where("not coalesce(step > 0 and bandwidth > 0, false)").select(
        *keys, F.lit(0).alias("point"), F.col("lo").cast("double").alias("x"), F.lit(None).cast("double").alias("density"))
    shape = shape.where("step > 0 and bandwidth > 0")
    joined = attach(cells.withColumnRenamed("n", "weight"), shape, keys).where(F.col("n").isNotNull())
    place = (F.col(value) - F.col("lo")) / F.col("step")
    bins = (
        joined.withColumn("__place", place)
        .withColumn("__bin", F.least(F.floor("__place"), F.lit(points - 2)))
        .withColumn("__right", F.col("__place") - F.col("__bin"))
        .groupBy(*keys, "n", "lo", "step", "bandwidth", "__bin")
        .agg(F.sum(F.col("weight") * (1 - F.col("__right"))).alias("__left"),
             F.sum(F.col("weight") * F.col("__right")).alias("__right"))
    )

    def kernel(steps):
        z = steps * F.col("step") / F.col("bandwidth")
        return F.exp(z * z * -0.5)

    heights = F.col("__left") * kernel(F.col("point") - F.col("__bin")) + F.col("__right") * kernel(
        F.col("point") - F.col("__bin") - 1
    )
    curves = (
        bins.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*keys, "point", "n", "lo", "step", "bandwidth")
        .agg(F.sum(heights).alias("__sum"))
        .select(
            *keys, "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
            (F.col("__sum") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )
    return curves.unionByName(flat)


def histogram(df, column):
    """Equal-width bins, as many as ceil(log2 n) + 1; empty bins stay."""
    known = df.where(F.col(column).isNotNull())
    ends = known.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not ends["n"]:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, n long")
    bins = math.ceil(math.log2(ends["n"])) + 1
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins
    if width == 0:
        bins, width = 1, 1.0
    number = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    counts = known.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_low"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def rounded_step(lo, hi, bins):
    """A step of 1, 2, 5 or 10 times a power of ten that cuts lo..hi into about ``bins`` parts.

    A width counts as the next larger of these steps above 1.4, 2.8 and 7 of its power of ten (fixed values).
    """
    width = (hi - lo) / bins
    power = 10.0 ** math.floor(math.log10(width))
    share = width / power
    return power * (1 if share <= 1.4 else 2 if share <= 2.8 else 5 if share <= 7 else 10)


def rounded_histogram(df, column):
    """Bins between multiples of a rounded step, open on the left; the first holds its lower end too.

    About ceil(log2 n) + 1 bins; empty ones stay. Values that are all equal make one bin around them.
    """
    known = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    ends = known.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not ends["n"]:
        return df.sparkSession.createDataFrame([], "bin int, bin_low double, bin_high double, n long")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    if lo < hi:
        step = rounded_step(lo, hi, math.ceil(math.log2(ends["n"])) + 1)
        first, last = math.floor(lo / step + 1e-7), math.ceil(hi / step - 1e-7)
    else:
        step, first = 1.0, math.floor(lo)
        last = first + 1
    number = F.ceil(F.col(column) / F.lit(step) - F.lit(1e-7)) - first
    placed = known.groupBy(F.greatest(F.lit(1), F.least(number, F.lit(last - first))).cast("int").alias("bin"))
    edges = df.sparkSession.range(1, last - first + 1).select(F.col("id").cast("int").alias("bin"))
    return edges.join(placed.agg(F.count(F.lit(1)).alias("n")), "bin", "left").select(
        "bin", ((first + F.col("bin") - 1) * F.lit(step)).alias("bin_low"), ((first + F.col("bin")) * F.lit(step)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def top3_points(entities, slopes, k=3):
    """Entities by group with their slope, the top-3 flag, the colour and the group's plot position."""
    joined = entities.join(slopes, "entity", "left")
    flagged = flag_first_k(joined, "group_name", "total_slope", k)
    coloured = flagged.withColumn("colour", other_unless(F.col("top3"), F.col("group_name")))
    return with_reverse_order(coloured)
