"""Contests and observations derived from the TPC-H-like tables.

An order is a contest between the regions that supply its lines; a line is one
observation of a supplier (the entity) playing for its region (the group), and the
line's quantity is the metric. See FIXTURES.md.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.operators.clean import recode
from swayline.skew import join_lookup

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

ROLE_OF_TYPE = {
    "forward": ["ECONOMY"], "midfielder": ["SMALL"], "defender": ["MEDIUM"],
    "ruck": ["LARGE"], "sub": ["PROMO"], "bench": [],
}
REGION_NAMES = {"AMERICA": "AMERICAS", "ASIA": "ASIA PACIFIC", "MIDDLE EAST": "GULF"}
SHARED_REGION_NAMES = ["AFRICA", "EUROPE"]


_schemas = {}


def table(spark, sf_dir, name):
    """One of the sample tables; its schema is read from the file once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = f"{sf_dir}/{name}.parquet"
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def supplier_groups(spark, sf_dir):
    """supplier key -> entity, group."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("s_suppkey", F.col("s_name").alias("entity"), F.col("r_name").alias("group_name"))
    )


def with_supplier(lines, spark, sf_dir):
    """Adds entity and group of the line's supplier; the supplier count comes from file footers."""
    size = table(spark, sf_dir, "supplier").count()
    return join_lookup(lines, supplier_groups(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"), size)


def observations(spark, sf_dir, with_role=False, group="region"):
    """One row per line: game, entity, group_name, metric (and role_code).

    ``group="status"`` uses the line status as the group, so that entities change group.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game"), "l_suppkey", "l_partkey", "l_linestatus",
        F.col("l_quantity").alias("metric"),
    )
    joined = with_supplier(lines, spark, sf_dir)
    if group == "status":
        joined = joined.withColumn("group_name", F.col("l_linestatus"))
    columns = ["game", "entity", "group_name", "metric"]
    if with_role:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("role_code"))
        joined = joined.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        columns.append("role_code")
    return joined.select(*columns)


def contests(spark, sf_dir, group="region"):
    """One row per order with the two strongest groups as home and away side.

    Points of a side are its summed quantity. A lone side meets an unnamed opponent with
    no points; an order without lines has NULL points. Odd orders swap home and away.
    The lines are summed per side first (combined on the map side), so the window sees at
    most one row per order and group, whatever the number of lines in an order.
    """
    strongest = W.partitionBy("game").orderBy(F.desc("points"), F.desc("group_name"))
    sides = (
        observations(spark, sf_dir, group=group)
        .groupBy("game", "group_name")
        .agg(F.sum("metric").alias("points"))
        .select(
            "game", F.col("group_name").alias("team1"), F.col("points").alias("points1"),
            F.lead("group_name").over(strongest).alias("team2"),
            F.coalesce(F.lead("points").over(strongest), F.lit(0.0)).alias("points2"),
            F.row_number().over(strongest).alias("place"),
        )
        .where("place = 1")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.to_date("o_orderdate").alias("date"), "o_orderpriority"
    )
    odd = F.pmod(F.col("o_orderkey"), F.lit(2)) == 1
    return (
        orders.join(sides, F.col("o_orderkey") == F.col("game"), "left")
        .select(
            F.col("o_orderkey").alias("game"),
            "date",
            F.year("date").alias("season"),
            F.month("date").cast("string").alias("round_number"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Finals").otherwise("Regular").alias("round_type"),
            F.when(odd, F.col("team2")).otherwise(F.col("team1")).alias("home_team"),
            F.when(odd, F.col("team1")).otherwise(F.col("team2")).alias("away_team"),
            F.when(odd, F.col("points2")).otherwise(F.col("points1")).alias("home_points"),
            F.when(odd, F.col("points1")).otherwise(F.col("points2")).alias("away_points"),
        )
    )


def raw_observations(spark, sf_dir):
    """Lines in the shape and spelling of a raw statistics feed, before any cleaning."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linestatus", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T09:30:00.000+0000"))
    return (
        with_supplier(lines, spark, sf_dir)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            text.alias("utcStartTime"),
            F.month("o_orderdate").alias("round.roundNumber"),
            F.substring_index("entity", "#", 1).alias("player.player.player.givenName"),
            F.substring_index("entity", "#", -1).alias("player.player.player.surname"),
            F.col("group_name").alias("team.name"),
            F.col("p_type").alias("player.player.position"),
            (F.col("l_linestatus") == "F").alias("player.player.player.captain"),
            F.col("p_size").alias("gamesPlayed"),
            F.when(F.col("o_orderstatus") != "P", F.col("l_quantity")).alias("ratingPoints"),
            F.col("group_name").alias("home.team.name"),
            F.col("l_linestatus").alias("away.team.name"),
        )
    )


def native_contests(spark, sf_dir):
    """One contest per date and pair of sides: the first order of that day with these sides."""
    own = F.struct("game", "round_number", "round_type", "home_points", "away_points")
    first = contests(spark, sf_dir).groupBy("date", "season", "home_team", "away_team").agg(F.min(own).alias("own"))
    return first.select("date", "season", "home_team", "away_team", "own.*")


def native_observations(spark, sf_dir):
    """Cleaned observations without a contest number: date, sides in the observation feed's spelling, parts of a name."""
    sides = contests(spark, sf_dir).select("game", "date", "season", "round_number", "home_team", "away_team")
    named = recode(sides, ["home_team", "away_team"], REGION_NAMES)
    lines = observations(spark, sf_dir, with_role=True).withColumnRenamed("game", "line_game")
    return lines.join(named, F.col("line_game") == F.col("game")).select(
        "date", "season", "round_number", F.substring_index("entity", "#", 1).alias("first_name"),
        F.substring_index("entity", "#", -1).alias("surname"), F.col("group_name").alias("team_name"),
        F.col("role_code").alias("player_position"), F.col("metric").alias("rating_points"), "home_team", "away_team",
    )


def messy_names(spark, sf_dir):
    """Lines with a hand-typed looking name: words, a hyphen, and mixed case."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("metric"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    name = F.concat(F.col("p_name"), F.lit("-"), F.col("p_brand"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.when(F.col("p_size") % 2 == 1, F.upper(name)).otherwise(name).alias("entity"), "metric"
    )


MESSY_ALIASES = {"Blue Bolt-Brand#1": "Blue Bolt-Brand#10", "Red Gear-Brand#2": "Red Gear-Brand#20"}
