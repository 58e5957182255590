"""Connected components of a graph of links, by alternating star contraction on Spark."""

from pyspark.sql import functions as F

from swayline.llm.common import written


def components(links):
    """(node, root): root is the smallest node of the component; ``links`` has long columns a and b.

    Large star: every node links its larger neighbours to its smallest one. Small star: every node
    links its smaller neighbours and itself to the smallest of them. Both only aggregate and join, so
    a node that holds a third of all links is summed before it is shuffled and split in the join. The
    links end as stars around the roots; each pass is written, and the number of passes grows with the
    logarithm of the number of nodes.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        edges = written(edges, "links")
        # stars: every node with a smaller neighbour has just one, and is nobody's smaller neighbour
        sides = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )
        if sides.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(small, F.col("u") == F.col("k"))
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionByName(small.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
