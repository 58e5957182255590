"""Cleaning of raw contests and observations."""

from pyspark.sql import functions as F

from swayline.functions.text import clean_names, date_part, many_parts, title_case

# Raw feed column (after name cleaning) -> our column.
OBSERVATION_COLUMNS = {
    "round_round_number": "round_number",
    "player_player_player_given_name": "first_name",
    "player_player_player_surname": "surname",
    "team_name": "team_name",
    "player_player_position": "player_position",
    "player_player_player_captain": "captain",
    "games_played": "games_played",
    "rating_points": "rating_points",
    "home_team_name": "home_team",
    "away_team_name": "away_team",
}


def with_winner(contests):
    """Name of the winning side, "Draw" on equal points, NULL when points are missing."""
    home, away = F.col("home_points"), F.col("away_points")
    return contests.withColumn(
        "winner",
        F.when(home > away, F.col("home_team")).when(home < away, F.col("away_team")).when(home == away, "Draw"),
    )


def clean_observations(raw):
    """Pick and rename the feed's columns; date and season come first and replace the timestamp."""
    df = nan_to_null(clean_names(raw))
    picked = df.select("utc_start_time", *[F.col(old).alias(new) for old, new in OBSERVATION_COLUMNS.items()])
    dated = picked.withColumn("date", date_part(F.col("utc_start_time")))
    return dated.withColumn("season", F.year("date")).drop("utc_start_time").select(
        "date", "season", *OBSERVATION_COLUMNS.values()
    )


def nan_to_null(df):
    """NaN in floating columns becomes NULL, so that averages and maxima skip it."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


def recode(df, columns, mapping):
    """Replace listed values in each column; other values stay."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    if not pairs:
        return df
    lookup = F.create_map(*pairs)
    return df.withColumns({c: F.coalesce(F.try_element_at(lookup, F.col(c)), F.col(c)) for c in columns})


def map_names(df, column, names, source="contest_name", target="observation_name"):
    """Left join of a name lookup table on ``column``; adds ``target``."""
    lookup = names.select(F.col(source).alias("__name"), target)
    return df.join(lookup, F.col(column) == F.col("__name"), "left").drop("__name")


def unmatched_names(df, column, names, target="observation_name"):
    """Values of ``column`` that the lookup does not know."""
    known = names.select(F.col(target).alias(column))
    return df.select(column).where(F.col(column).isNotNull()).distinct().join(known, column, "left_anti")


def normalise_names(df, column="entity", aliases=None):
    """Title case plus the known aliases, so that spellings of one entity meet."""
    return recode(df.withColumn(column, title_case(F.col(column))), [column], aliases or {})


def role_of(code, role_codes):
    """Role of a position code; NULL for codes in no role."""
    result = None
    for role, codes in role_codes.items():
        if codes:
            result = (F if result is None else result).when(code.isin(codes), role)
    return result if result is not None else F.lit(None).cast("string")


def name_audit(summary, column="entity"):
    """Names of three words or with a hyphen, sorted: candidates for double spellings."""
    return summary.where(many_parts(F.col(column))).orderBy(column)


def colliding_spellings(frame, column="entity", aliases=None):
    """Normalised names reached from more than one raw spelling."""
    raw = frame.select(F.col(column).alias("raw_name"), F.col(column)).distinct()
    return (
        normalise_names(raw, column, aliases)
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_spellings"), F.min("raw_name").alias("first_spelling"),
             F.max("raw_name").alias("last_spelling"))
        .where("n_spellings > 1")
    )


def null_audit(df):
    """(column_name, n_missing) for every numeric column, from one pass."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")
               or f.dataType.typeName().startswith("decimal")]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric])
    return counts.unpivot([], numeric, "column_name", "n_missing")


def distinct_sorted(df, column):
    return df.select(column).distinct().orderBy(F.asc_nulls_last(column))
