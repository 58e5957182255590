"""Cleaning, joins and the model frame on a hand-written fixture."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline import skew
from swayline.functions import text
from swayline.operators import clean, frame, summary
from swayline.sources import files, lookups

DAY = dt.date(2023, 4, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def contests(spark):
    rows = [
        (day(0), 2023, "Geelong", "Sydney", 90.0, 80.0, "Regular", 1, "1"),
        (day(7), 2023, "Sydney", "Geelong", 70.0, 70.0, "Regular", 2, "2"),
        (day(14), 2023, "Geelong", "Carlton", None, None, "Regular", 3, "3"),
        (day(21), 2023, "Carlton", "Sydney", 60.0, 100.0, "Finals", 4, "4"),
    ]
    schema = ("date date, season int, home_team string, away_team string, home_points double, away_points double, "
              "round_type string, game int, round_number string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def raw(spark):
    def row(n, given, surname, team, code, points, home, away):
        return (f"{day(n)}T05:00:00.000+0000", 1, given, surname, team, code, True, 10, points, home, away)

    rows = [
        row(0, "Jordan", "de Goey", "Geelong Cats", "FF", 10.0, "Geelong Cats", "Sydney Swans"),
        row(0, "Jordan", "De Goey", "Geelong Cats", "CHF", 20.0, "Geelong Cats", "Sydney Swans"),
        row(0, "Cam", "Ellis-Yolmen", "Sydney Swans", "RK", 5.0, "Geelong Cats", "Sydney Swans"),
        row(7, "Cameron", "Ellis-Yolmen", "Sydney Swans", "RK", 7.0, "Sydney Swans", "Geelong Cats"),
        row(7, "Sam", "Hall", "Geelong Cats", "EMERG", None, "Sydney Swans", "Geelong Cats"),
        row(7, "Sam", "Hall", "Geelong Cats", None, 3.0, "Sydney Swans", "Geelong Cats"),
        row(14, "Sam", "Hall", "Geelong Cats", "INT", 4.0, "Geelong Cats", "Carlton"),
        row(21, "Sam", "Hall", "Sydney Swans", "INT", 6.0, "Carlton", "Sydney Swans"),
        row(21, "Sam", "Hall", "Carlton", "C", 8.0, "Carlton", "Sydney Swans"),
        row(30, "Pat", "Twin", "Carlton", "C", 9.0, "Carlton", "Geelong Cats"),
    ]
    columns = ["utcStartTime", "round.roundNumber", "player.player.player.givenName", "player.player.player.surname",
               "team.name", "player.player.position", "player.player.player.captain", "gamesPlayed", "ratingPoints",
               "home.team.name", "away.team.name"]
    types = ["string", "int", "string", "string", "string", "string", "boolean", "int", "double", "string", "string"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(columns, types)))


@pytest.fixture(scope="module")
def observed(raw, contests):
    named = clean.recode(clean.with_winner(contests), ["home_team", "away_team", "winner"], lookups.GROUP_NAMES)
    return frame.native_frame(clean.clean_observations(raw), named)


def test_snake_names():
    assert text.snake_names(["utcStartTime", "round.roundNumber", "Team Name", "team_name", "% won", "2nd", "HTTPCode"]) == [
        "utc_start_time", "round_round_number", "team_name", "team_name_2", "percent_won", "x2nd", "http_code"]


def test_title_case(spark):
    df = spark.createDataFrame([("cameron ellis-yolmen",), ("JORDAN DE GOEY",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(text.title_case(F.col("n"))).collect()] == [
        "Cameron Ellis-Yolmen", "Jordan De Goey", "", None]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2023-04-01T05:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(text.date_part(F.col("t"))).collect()] == [DAY, None, None]


def test_winner(contests):
    got = {r["game"]: r["winner"] for r in clean.with_winner(contests).collect()}
    assert got == {1: "Geelong", 2: "Draw", 3: None, 4: "Sydney"}


def test_clean_observations(raw):
    cleaned = clean.clean_observations(raw)
    assert cleaned.columns == ["date", "season", "round_number", "first_name", "surname", "team_name", "player_position",
                               "captain", "games_played", "rating_points", "home_team", "away_team"]
    assert cleaned.first()["date"] == DAY and cleaned.first()["season"] == 2023


def test_recode_and_name_map(spark, contests):
    names = lookups.group_name_table(spark)
    assert names.count() == 18
    won = clean.with_winner(contests)
    mapped = {r["game"]: r["observation_name"] for r in clean.map_names(won, "winner", names).collect()}
    assert mapped == {1: "Geelong Cats", 2: None, 3: None, 4: "Sydney Swans"}
    recoded = clean.recode(won, ["home_team", "winner"], lookups.GROUP_NAMES).orderBy("game").collect()
    assert [r["home_team"] for r in recoded] == ["Geelong Cats", "Sydney Swans", "Geelong Cats", "Carlton"]
    assert recoded[1]["winner"] == "Draw"
    assert [r[0] for r in clean.unmatched_names(won, "home_team", names).orderBy("home_team").collect()] == [
        "Geelong", "Sydney"]


def test_join_keeps_unmatched_and_drops_missing_metric(observed):
    rows = observed.collect()
    assert len(rows) == 9
    twin = [r for r in rows if r["entity"] == "Pat Twin"][0]
    assert twin["game"] is None and twin["winner"] is None


def test_outcome_and_final(observed):
    got = {(r["entity"], r["date"], r["group_name"]): (r["outcome"], r["final"])
           for r in frame.with_outcome(observed).collect()}
    assert got[("Jordan de Goey", day(0), "Geelong Cats")] == (1.0, 0)
    assert got[("Cam Ellis-Yolmen", day(0), "Sydney Swans")] == (0.0, 0)
    assert got[("Cameron Ellis-Yolmen", day(7), "Sydney Swans")] == (0.0, 0)  # draw
    assert got[("Sam Hall", day(14), "Geelong Cats")] == (None, 0)  # no result yet
    assert got[("Sam Hall", day(21), "Sydney Swans")] == (1.0, 1)
    assert got[("Pat Twin", day(30), "Carlton")] == (None, 0)


def test_summary_merges_spellings(observed):
    merged = clean.normalise_names(observed, "entity", lookups.ENTITY_ALIASES)
    got = {r["entity"]: r for r in summary.entity_summary(merged).collect()}
    assert set(got) == {"Jordan De Goey", "Cameron Ellis-Yolmen", "Sam Hall", "Pat Twin"}
    goey = got["Jordan De Goey"]
    assert (goey["mean_metric"], goey["median_metric"], goey["max_metric"], goey["min_metric"], goey["n_contests"]) == (
        15.0, 15.0, 20.0, 10.0, 2)
    names = [r["entity"] for r in clean.name_audit(summary.entity_summary(merged)).collect()]
    assert names == ["Cameron Ellis-Yolmen", "Jordan De Goey"]
    clash = clean.colliding_spellings(observed, "entity", lookups.ENTITY_ALIASES).collect()
    assert {r["entity"] for r in clash} == {"Jordan De Goey", "Cameron Ellis-Yolmen"}


def test_null_audit(raw):
    got = {r["column_name"]: r["n_missing"] for r in clean.null_audit(clean.clean_observations(raw)).collect()}
    assert got == {"season": 0, "round_number": 0, "games_played": 0, "rating_points": 1}


def test_appearances_and_join_form(observed):
    rows = observed.select("date", "game", "entity", "group_name", "metric")
    numbered = frame.appearance_number(rows)
    hall = sorted((r["date"], r["group_name"], r["appearance"]) for r in numbered.where("entity = 'Sam Hall'").collect())
    assert [h[2] for h in hall] == [1, 2, 3, 4]
    assert hall[2][1] == "Carlton"  # the rest of the row breaks the tie on a date
    # the join form repeats rows of an entity met twice on one date: 1 + 1 + 2 * 2
    assert frame.join_appearances(rows, numbered).where("entity = 'Sam Hall'").count() == 6


def test_primary_role_and_dummies(observed):
    got = {r["entity"]: r["role"] for r in frame.primary_role(observed, lookups.ROLE_CODES).collect()}
    assert got["Sam Hall"] == "bench" and got["Jordan de Goey"] == "forward" and got["Cam Ellis-Yolmen"] == "ruck"
    wide = frame.model_frame(observed, lookups.ROLE_CODES, "2022-01-01", min_rows=1)
    dummies = [c for c in wide.columns if c.startswith("role_")] + ["no_role"]
    assert all(sum(r[c] for c in dummies) == 1 for r in wide.select(*dummies).collect())


def test_unknown_role_gets_its_own_column(spark):
    df = spark.createDataFrame([(1, "ruck"), (2, None)], "id int, role string")
    by_case = sorted(map(tuple, frame.role_dummies(df).collect()))
    by_pivot = frame.role_dummies_pivot(df, ["id"])
    assert by_case == sorted(map(tuple, by_pivot.select("id", *frame.role_dummies(df).columns[1:]).collect()))
    assert [r["no_role"] for r in frame.role_dummies(df).orderBy("id").collect()] == [0, 1]


def test_threshold_and_constant_metric(spark):
    rows = [("a", "g", 1.0)] * 3 + [("b", "g", float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "entity string, group_name string, metric double")
    kept = frame.eligible(df, ["entity", "group_name"], 3)
    assert {r["entity"] for r in kept.collect()} == {"a"}


def test_since_is_strict(spark):
    df = spark.createDataFrame([(day(0),), (day(1),)], "date date")
    assert [r[0] for r in frame.since(df, str(DAY)).collect()] == [day(1)]


def skewed(spark):
    rows = [("hot", day(i % 50), i, float(i % 7)) for i in range(600)]
    rows += [(f"e{i % 20}", day(i % 30), i, float(i % 5)) for i in range(600)]
    rows += [("hot", day(3), 3, 3.0)] * 20
    return spark.createDataFrame(rows, "entity string, date date, game int, metric double")


def test_hot_key_paths_equal_plain_paths(spark, monkeypatch):
    df = skewed(spark)
    stats = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"))
    plain = sorted(map(tuple, skew.attach(df, stats, ["entity"]).collect()))
    window = W.partitionBy("entity").orderBy("date", "game", "metric")
    numbered = sorted(map(tuple, df.withColumn("k", F.row_number().over(window)).collect()))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    assert skew.hot_keys(df, "entity") == ["hot"]
    salted = skew.attach(df, stats, ["entity"])
    assert sorted(map(tuple, salted.collect())) == plain
    split = skew.running_number(df, "entity", ["date", "game", "metric"], "k")
    assert sorted(map(tuple, split.collect())) == numbered


def test_missing_keys_match_each_other(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert {(r["k"], r["n"]) for r in skew.attach(df, stats, ["k"]).collect()} == {("a", 1), (None, 1)}


def test_seasons_union_and_sink(spark, tmp_path):
    one = spark.createDataFrame([(1, 5.0)], "game int, points double").withColumn("season", F.lit(2019))
    two = spark.createDataFrame([(2, "x")], "game int, venue string").withColumn("season", F.lit(2021))
    both = files.union_by_name([one, two])
    assert {(r["game"], r["points"], r["venue"]) for r in both.collect()} == {(1, 5.0, None), (2, None, "x")}
    path = str(tmp_path / "contests")
    both.write.partitionBy("season").parquet(path)
    picked = files.read_seasons(spark, path, 2020)
    assert [r["game"] for r in picked.collect()] == [2]
    plan = picked._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    out = files.write_result(picked, str(tmp_path / "result"))
    assert spark.read.parquet(out).count() == 1
    assert files.current_season(spark) >= 2024


def test_current_group_differs_from_all_groups(spark):
    rows = [("a", "x", day(0), 1), ("a", "y", day(5), 2), ("b", "x", day(1), 1)]
    df = spark.createDataFrame(rows, "entity string, group_name string, date date, game int")
    got = {(r["entity"], r["group_name"]): r["is_current"] for r in summary.with_current_group(df).collect()}
    assert got == {("a", "x"): False, ("a", "y"): True, ("b", "x"): True}


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert clean.nan_to_null(df).agg(F.max("v"), F.count("v")).first() == (1.0, 1)


def test_metric_by_outcome(observed):
    got = {r["outcome"]: r["mean_metric"] for r in summary.metric_by_outcome(frame.with_outcome(observed), "Sam Hall").collect()}
    assert got == {0.0: statistics.mean([3.0, 8.0]), None: 4.0, 1.0: 6.0}


def test_season_store_replaces_one_season_and_prunes(spark, tmp_path):
    path = str(tmp_path / "seasons")
    first = spark.createDataFrame([(2010, "a", 1), (2011, "b", 2), (2012, "c", 3)], "season int, name string, n int")
    files.write_seasons(first, path)
    files.write_seasons(spark.createDataFrame([(2011, "new", 1.5)], "season int, name string, extra double"), path)
    schema = "name string, n int, extra double, season int"
    got = files.read_seasons(spark, path, 2010, 2011, schema=schema)
    assert sorted(map(tuple, got.collect())) == [("a", 1, None, 2010), ("new", None, 1.5, 2011)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2011" in plan
    assert files.read_seasons(spark, path, 2010).count() == 3  # up to this year; schemas merged
    stacked = files.union_by_name([first.where("season = 2010"), got.where("season = 2011").drop("n")])
    assert sorted((r.season, r.n, r.extra) for r in stacked.collect()) == [(2010, 1, None), (2011, None, 1.5)]


def test_join_audit_counts_both_sides(spark):
    keys = "date string, season int, home_team string, away_team string"
    observed = spark.createDataFrame([("d1", 1, "A", "B"), ("d1", 1, "A", "B"), ("d2", 1, "X", "B"), ("d3", 1, "A", None)], keys)
    played = spark.createDataFrame([("d1", 1, "A", "B"), ("d2", 1, "Y", "B"), ("d3", 1, "A", None)], keys)
    got = {(r.side, r.home_team, r.away_team): r.n for r in frame.join_audit(observed, played).collect()}
    assert got == {("observations", "X", "B"): 1, ("observations", "A", None): 1, ("contests", "Y", "B"): 1, ("contests", "A", None): 1}
