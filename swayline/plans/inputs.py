"""Frames the named analyses start from, and the thresholds that suit the sample tables."""

from pyspark.sql import functions as F

from swayline.operators.clean import with_winner
from swayline.operators.features import outcome_cells
from swayline.operators.frame import eligible, join_contests, since, with_outcome
from swayline.scratch import materialise
from swayline.sources import roles

START_DATE = "1996-12-31"
MIN_ROWS = 400
MIN_RECENT = 130


def observed(spark, sf_dir, with_role=False, group="region"):
    """Observations joined to their contest and its winner, metric present."""
    obs = roles.observations(spark, sf_dir, with_role, group)
    joined = join_contests(obs, with_winner(roles.contests(spark, sf_dir, group)), ["game"])
    return joined.where(F.col("metric").isNotNull())


def outcome_frame(spark, sf_dir, group="region"):
    """Rows after the start date with outcome and finals flag."""
    return with_outcome(since(observed(spark, sf_dir, group=group), START_DATE))


def eligible_rows(spark, sf_dir):
    """Written rows of the entities that have enough rows for their group."""
    columns = ["date", "game", "season", "entity", "group_name", "metric", "outcome"]
    frame = materialise(outcome_frame(spark, sf_dir).select(*columns), "frame")
    return eligible(frame, ["entity", "group_name"], MIN_ROWS)


def eligible_cells(spark, sf_dir, group="region", min_rows=MIN_ROWS):
    """The same rows merged into cells: the input of every fitted model."""
    cells = materialise(outcome_cells(outcome_frame(spark, sf_dir, group)), "cells")
    return materialise(eligible(cells, ["entity", "group_name"], min_rows, weight="n_rows"), "cells")
