"""Exact quantiles per key without holding a key's values in one task.

Values are first merged into (key, value, count) cells. Keys with few distinct values
use Spark's ``percentile`` over the counts. For the others each wanted rank is narrowed
down by counting value ranges: 1024 ranges per round, until the range is one value.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.scratch import materialise
from swayline.skew import attach

DIRECT_CELLS = 100_000
RANGES = 1024


def value_cells(frame, keys, value, weight=None):
    """(keys, value, n): how often each value occurs per key."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(rows.alias("n"))


def cell_quantiles(cells, keys, value, probs):
    """(keys, q0, q1, ...) for ``probs`` from a written cell table, interpolating between ranks."""
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_total"))
    sizes = materialise(sizes, "sizes")
    largest = sizes.agg(F.max("n_cells")).first()[0] or 0
    if largest <= DIRECT_CELLS:
        return _direct(cells, keys, value, probs)
    marked = attach(cells, sizes, keys, rows="n_cells", scanned=True)
    small = _direct(marked.where(F.col("n_cells") <= DIRECT_CELLS), keys, value, probs)
    wide = materialise(marked.where(F.col("n_cells") > DIRECT_CELLS), "wide").drop("n_cells", "n_total")
    return small.unionByName(_by_ranges(wide, keys, value, probs))


def _direct(cells, keys, value, probs):
    quantiles = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), F.col("n"))
    packed = cells.groupBy(*keys).agg(quantiles.alias("__q"))
    return packed.select(*keys, *[F.get("__q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])


def _by_ranges(cells, keys, value, probs):
    position = [(F.col("n_total") - 1) * F.lit(float(p)) + 1 for p in probs]
    wanted = [
        F.struct(F.lit(i).alias("prob"), F.lit(side).alias("side"), rank(h).cast("long").alias("rank"))
        for i, h in enumerate(position)
        for side, rank in (("lower", F.floor), ("upper", F.ceil))
    ]
    targets = (
        cells.groupBy(*keys)
        .agg(F.sum("n").alias("n_total"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        .select(*keys, "lo", "hi", "n_total", F.lit(0).cast("long").alias("below"), F.inline(F.array(*wanted)))
    )
    targets = materialise(targets, "ranks")
    label = [*keys, "prob", "side", "rank"]
    while targets.where("lo < hi").limit(1).count():
        inside = attach(cells, targets, keys, rows="n_total", scanned=True).where(
            (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
        )
        share = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
        counted = (
            inside.withColumn("__range", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)))
            .groupBy(*label, "n_total", "below", "__range")
            .agg(F.sum("n").alias("__n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        )
        up_to = W.partitionBy(*label).orderBy("__range").rowsBetween(W.unboundedPreceding, 0)
        reached = counted.withColumn("__upto", F.col("below") + F.sum("__n").over(up_to)).where(
            (F.col("__upto") >= F.col("rank")) & (F.col("__upto") - F.col("__n") < F.col("rank"))
        )
        targets = materialise(
            reached.select(*keys, "lo", "hi", "n_total", (F.col("__upto") - F.col("__n")).alias("below"),
                           "prob", "side", "rank"),
            "ranks",
        )
    found = targets.groupBy(*keys).agg(*[
        _between(i, float(p)).alias(f"q{i}") for i, p in enumerate(probs)
    ])
    return found


def _between(i, p):
    def pick(side):
        return F.max(F.when((F.col("prob") == i) & (F.col("side") == side), F.col("lo")))

    h = (F.max("n_total") - 1) * F.lit(p) + 1
    return pick("lower") + (h - F.floor(h)) * (pick("upper") - pick("lower"))
