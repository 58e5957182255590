"""Rankings inside groups. Spark trims every partition to k rows per group before it shuffles."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(column, ties):
    return [F.desc_nulls_last(column), *ties]


def top_with_ties(df, group, column, k=1):
    """The k largest per group; rows equal to the k-th stay."""
    ranked = df.withColumn("__rank", F.rank().over(W.partitionBy(group).orderBy(F.desc_nulls_last(column))))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def first_k(df, group, column, k=3, tie_break=("entity",)):
    """Exactly the first k per group; equal values are ordered by ``tie_break``."""
    window = W.partitionBy(group).orderBy(*_order(column, tie_break))
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= k).drop("__rank")


def flag_first_k(df, group, column, k=3, by="entity", tie_break=("entity",)):
    """Adds boolean ``top3``: TRUE for an entity that is among the first k of any group.

    The flag is joined back by ``by`` alone, so an entity in two groups is flagged in both.
    """
    best = first_k(df, group, column, k, tie_break).select(by).distinct().withColumn("__top", F.lit(True))
    joined = df.join(best, by, "left")
    return joined.withColumn("top3", F.col("__top").isNotNull()).drop("__top")


def ranked(df, column, tie_break=("entity",), n=None):
    """Largest first, missing last; only the first ``n`` if given."""
    ordered = df.orderBy(*_order(column, tie_break))
    return ordered if n is None else ordered.limit(n)


def one_group(df, group, column, n=None):
    """Ranked rows of one group."""
    return ranked(df.where(F.col("group_name") == group), column, n=n)


def other_unless(flag, column):
    """The column where the flag holds, "Other" elsewhere."""
    return F.when(flag, column).otherwise("Other")


def with_reverse_order(df, column="group_name", name="group_order"):
    """Adds the position of the row's group when groups are listed backwards."""
    groups = df.select(column).distinct()
    order = groups.withColumn(name, F.dense_rank().over(W.orderBy(F.desc(column))))
    return df.join(order, column, "left")
