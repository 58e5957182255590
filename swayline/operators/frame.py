"""The model frame: contest outcome, flags, counters and role dummies on every observation."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.functions.text import full_name
from swayline.operators.clean import role_of
from swayline.operators.moments import moments
from swayline.scratch import materialise
from swayline.skew import attach, running_number

CONTEST_KEYS = ["date", "home_team", "away_team", "season"]
ROLES = ["forward", "midfielder", "defender", "ruck", "sub", "bench"]


def join_contests(observations, contests, keys=None):
    """Observations with their contest's columns; unmatched observations keep NULLs there.

    A contest column that the observations also have is dropped from the contest side.
    """
    keys = CONTEST_KEYS if keys is None else keys
    clash = [c for c in contests.columns if c in observations.columns and c not in keys]
    return observations.join(contests.drop(*clash), keys, "left")


def join_audit(observations, contests, keys=None, names=("home_team", "away_team")):
    """(side, *names, n): rows of either side that the other has no match for, counted by names.

    Keys with a missing part match nothing. Both directions are anti-joins, so no row is repeated.
    """
    keys = CONTEST_KEYS if keys is None else keys
    sides = []
    for side, rows, others in (("observations", observations, contests), ("contests", contests, observations)):
        left = rows.join(others.select(*keys), keys, "left_anti")
        sides.append(left.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), *names, "n"))
    return sides[0].unionByName(sides[1])


def native_frame(observations, contests):
    """Cleaned observations joined to contests, in the column names the models use."""
    joined = join_contests(observations, contests)
    return joined.where(F.col("rating_points").isNotNull()).select(
        "date", "season", "game", "round_number", "round_type", "winner",
        full_name("first_name", "surname").alias("entity"),
        F.col("team_name").alias("group_name"),
        F.col("rating_points").alias("metric"),
        F.col("player_position").alias("role_code"),
    )


def outcome(group, winner):
    """1.0 if the group won, 0.0 if not (a draw too), NULL while the winner is unknown."""
    return (group == winner).cast("double")


def with_outcome(frame):
    return frame.withColumns({
        "outcome": outcome(F.col("group_name"), F.col("winner")),
        "final": (F.col("round_type") == "Finals").cast("int"),
    }).fillna({"final": 0})


def since(frame, date):
    """Rows strictly after ``date``."""
    return frame.where(F.col("date") > F.lit(date).cast("date"))


def appearance_number(frame, name="appearance"):
    """Running count of an entity's observations by date; the rest of the row breaks ties."""
    order = ["date"] + [c for c in ("game", "group_name", "metric") if c in frame.columns]
    return running_number(frame, "entity", order, name)


def join_appearances(frame, counters):
    """Join form of the counter on (date, entity): repeats rows of entities met twice on a date."""
    return frame.join(counters.select("date", "entity", "appearance"), ["date", "entity"], "left")


def role_counts(frame, role_codes):
    """(entity, role, role_count); a code in no role counts as the NULL role."""
    return (
        frame.select("entity", role_of(F.col("role_code"), role_codes).alias("role"))
        .groupBy("entity", "role")
        .agg(F.count(F.lit(1)).alias("role_count"))
    )


def primary_role(frame, role_codes):
    """Most frequent role per entity; ties go to the first role in alphabetical order.

    Counted first, so the window sees at most one row per entity and role.
    """
    best = W.partitionBy("entity").orderBy(F.desc("role_count"), F.asc_nulls_last("role"))
    return (
        role_counts(frame, role_codes)
        .withColumn("__rank", F.row_number().over(best))
        .where("__rank = 1")
        .drop("__rank")
    )


def role_dummies(frame, roles=None):
    """One 0/1 column per role, and ``no_role`` for the NULL role."""
    roles = ROLES if roles is None else roles
    dummies = {f"role_{r}": F.when(F.col("role") == r, 1).otherwise(0) for r in roles}
    dummies["no_role"] = F.col("role").isNull().cast("int")
    return frame.withColumns(dummies).drop("role")


def role_dummies_pivot(frame, keys, roles=None):
    """The same columns through a grouped pivot; needs ``keys`` to identify a row."""
    roles = ROLES if roles is None else roles
    filled = frame.withColumn("role", F.coalesce("role", F.lit("__none")))
    wide = filled.groupBy(*keys).pivot("role", roles + ["__none"]).agg(F.count(F.lit(1)).cast("int")).fillna(0)
    renamed = wide.withColumnsRenamed({r: f"role_{r}" for r in roles})
    return renamed.withColumnRenamed("__none", "no_role")


def eligible(frame, keys, min_rows, weight=None):
    """Rows of keys with at least ``min_rows`` observations, counted by a grouped aggregate."""
    counts = frame.groupBy(*keys).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")
    )
    return attach(frame, counts, keys).where(F.col("n") >= min_rows).drop("n")


def model_frame(observed, role_codes, start_date, min_rows=30):
    """Every observation after ``start_date`` of the entities with enough rows for their group."""
    frame = materialise(with_outcome(since(observed, start_date)), "frame")
    numbered = materialise(appearance_number(frame), "numbered")
    dummies = role_dummies(attach(numbered, primary_role(frame, role_codes), ["entity"], rows="role_count"))
    stats = moments(frame, ["entity", "group_name"], "metric")
    scored = attach(dummies, stats, ["entity", "group_name"]).where(F.col("n") >= min_rows)
    return scored.select(
        "date", "game", "season", "round_number", "entity", "metric", "group_name", "outcome", "final",
        "appearance", *[f"role_{r}" for r in ROLES], "no_role",
        F.try_divide(F.col("metric") - F.col("mean"), F.col("sd")).alias("std_metric"),
    )
