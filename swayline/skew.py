"""Joins and running numbers that stay balanced when one key holds a large share of all rows.

A key is *hot* when it has more rows than both ``HOT_ROWS`` and ``HOT_SHARE`` of the
total. At most ``1 / HOT_SHARE`` keys can be hot, so the set of hot keys has a proven
size bound and may be broadcast or listed.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.scratch import materialise

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
HOT_SHARE = 1 / 1000
HOT_ROWS = 1_000_000
SALTS = 256


def small(df, size):
    """Whether ``size`` rows of ``df`` may be broadcast: by number and by estimated bytes (8 for a number, 48 for a text)."""
    width = sum(48 if f.dataType.typeName() in ("string", "binary", "array", "struct", "map") else 8 for f in df.schema.fields)
    return size <= BROADCAST_ROWS and size * width <= BROADCAST_BYTES


def _null_safe(left, right, keys, extra=(), how="left"):
    """Equi-join in which a missing key matches a missing key; key columns of ``left`` stay."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    condition += [F.col(k) == F.col(f"__r{k}") for k in extra]
    return left.join(right, condition, how).drop(*[f"__r_{k}" for k in keys])


def attach(frame, stats, keys, rows="n", size=None, scanned=False):
    """Left-join per-key ``stats`` onto ``frame`` without moving a hot key into one task.

    ``stats`` is written first, so its size is known (a caller who has counted it already
    passes ``size``): up to ``BROADCAST_ROWS`` rows are
    broadcast and ``frame`` is not shuffled. Beyond that both sides are shuffled, and
    the rows of hot keys (found from the ``rows`` column of ``stats``) are spread over
    ``SALTS`` sub-keys. There ``frame`` is written first as well, unless it is ``scanned`` from
    files already: the salt counts rows of a scan, so a repeated task gives its rows the same salts.
    """
    if size is None or not small(stats, size):
        stats = materialise(stats, "stats")
        size = stats.count()
    if small(stats, size):
        return _null_safe(frame, F.broadcast(stats), keys)
    if not scanned:
        frame = materialise(frame, "frame")
    # stats may have several rows of a key, each with the key's number of rows
    sizes = stats.groupBy(*keys).agg(F.max(rows).alias("__rows"))
    total = sizes.agg(F.sum("__rows")).first()[0] or 0
    hot = sizes.where(F.col("__rows") > max(total * HOT_SHARE, HOT_ROWS)).select(*keys, F.lit(True).alias("__hot"))
    salted = _null_safe(frame, F.broadcast(hot), keys).withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)),
    )
    spread = (
        _null_safe(stats, F.broadcast(hot), keys)
        .withColumn(
            "__r__salt",
            F.explode(
                F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("__hot")
    )
    joined = _null_safe(salted, spread, keys, extra=["__salt"])
    return joined.drop("__salt", "__r__salt", "__hot")


def join_lookup(frame, lookup, condition, size):
    """Left join of a lookup table with ``size`` rows: broadcast up to ``BROADCAST_ROWS``.

    Spark overestimates a lookup that is itself a join, and would shuffle ``frame`` for it.
    A larger lookup is joined by a shuffle, in which adaptive execution splits hot keys.
    """
    return frame.join(F.broadcast(lookup) if small(lookup, size) else lookup, condition, "left")


def hot_keys(frame, key):
    """Values of ``key`` that are hot in ``frame``; at most ``1 / HOT_SHARE`` of them."""
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    rows = counts.where((F.col("n") > HOT_ROWS) & (F.col("n") > total * F.lit(HOT_SHARE))).select(key)
    return [r[0] for r in rows.collect()]


def running_number(frame, key, order, name):
    """1, 2, 3, ... per ``key`` in the order of the columns ``order``; full ties are numbered in any order.

    Cold keys: one plain window. Rows of hot keys are written with a number that tells ties apart, dealt by
    Spark into ordered ranges of about ``HOT_ROWS`` rows, numbered inside their range and shifted by the row
    counts of the key's earlier ranges. So no task sorts more than a range, however many rows share a key or all
    of ``order``. The ranges are written before they are counted, so a repeated task finds the same ones.
    """
    hot = hot_keys(frame, key)
    if not hot:
        return frame.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))
    is_hot = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False))
    if None in hot:  # rows without a key are one partition of their own
        is_hot = is_hot | F.col(key).isNull()
    cold = frame.where(~is_hot).withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))
    rows = materialise(frame.where(is_hot).withColumn("__id", F.monotonically_increasing_id()), "hot")
    ranges = 1 + rows.count() // HOT_ROWS
    ranged = materialise(
        rows.repartitionByRange(ranges, key, *order, "__id").withColumn("__range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n")).select(
        F.col(key).alias("__key"), F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__local", F.row_number().over(W.partitionBy(key, "__range").orderBy(*order, "__id")))
    # at most a row for each range and hot key
    joined = numbered.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    total = (F.col("__local") + F.col("__before")).cast("int").alias(name)
    return cold.unionByName(joined.select(*frame.columns, total))
