"""Season-partitioned sources and the result sink."""

import functools

from pyspark.sql import functions as F


def current_season(spark):
    """Year of today's date: the usual end of a season range."""
    return spark.range(1).select(F.year(F.current_date())).first()[0]


def read_seasons(spark, path, first, last=None, schema=None):
    """Seasons ``first``..``last`` of a dataset laid out as ``season=YYYY/`` folders.

    The range becomes a partition filter, so other seasons are not listed or read.
    """
    last = current_season(spark) if last is None else last
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(path).where(F.col("season").between(first, last))


def write_seasons(df, path):
    """Write ``df`` as ``season=YYYY/`` folders; only the seasons it has are replaced, so a rerun of one leaves the rest."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    return path


def union_by_name(frames):
    """Stack frames by column name; columns a frame lacks become NULL."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_result(df, path):
    """Save one result table."""
    df.write.mode("overwrite").parquet(path)
    return path
