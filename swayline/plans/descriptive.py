"""Cleaning, summary, feature and plot queries over the sample tables."""

from pyspark.sql import functions as F

from swayline.operators import clean, effects, features, frame, linear, plotdata, ranking, summary
from swayline.plans import inputs
from swayline.scratch import materialise, new_path
from swayline.sources import files, roles
from swayline.sources.lookups import group_name_table

#: Name that the audited map lacks; first season that is read, and the first that is stored with all columns.
LACKING, FIRST_SEASON, DRIFT = "MIDDLE EAST", 1996, 1998
#: Entities that contrasts refer to in their groups, first choice first.
CHOSEN = ["Supplier#000000009", "Supplier#000000008", "Supplier#000000007"]
TRIAL = ["Supplier#000000001", "Supplier#000000004", "Supplier#000000007"]


def rounded(df, digits=6):
    """Doubles to ``digits`` places; adding zero turns -0.0 into 0.0."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles})


def contest_winner(spark, sf_dir):
    return clean.with_winner(roles.contests(spark, sf_dir))


def clean_observations(spark, sf_dir):
    cleaned = clean.clean_observations(roles.raw_observations(spark, sf_dir))
    return cleaned.where(F.col("rating_points").isNotNull())


def recode_groups(spark, sf_dir):
    names = group_name_table(spark, roles.REGION_NAMES, roles.SHARED_REGION_NAMES)
    named = clean.map_names(contest_winner(spark, sf_dir), "winner", names)
    recoded = clean.recode(named, ["home_team", "away_team", "winner"], roles.REGION_NAMES)
    return recoded.select("game", "home_team", "away_team", "winner", "observation_name")


def group_names(spark, sf_dir):
    return clean.distinct_sorted(roles.contests(spark, sf_dir), "away_team")


def join_contests(spark, sf_dir):
    joined = inputs.observed(spark, sf_dir)
    return joined.select("date", "season", "game", "round_type", "winner", "entity", "group_name", "metric")


def native_join(spark, sf_dir):
    """The frame of observations joined to contests on date, sides and season, with names built from their parts."""
    played = clean.recode(clean.with_winner(roles.native_contests(spark, sf_dir)), ["home_team", "away_team", "winner"], roles.REGION_NAMES)
    return frame.native_frame(roles.native_observations(spark, sf_dir), played)


def native_join_audit(spark, sf_dir):
    """What that join misses on either side when the name map lacks one spelling."""
    known = {k: v for k, v in roles.REGION_NAMES.items() if k != LACKING}
    played = clean.recode(roles.native_contests(spark, sf_dir), ["home_team", "away_team"], known)
    return frame.join_audit(roles.native_observations(spark, sf_dir), played)


def season_store(spark, sf_dir):
    """Contests stored by season, one season stored again with another schema, and a range of seasons read back."""
    played, path = contest_winner(spark, sf_dir), new_path(spark, "seasons")
    wide = materialise(played, "contests")
    files.write_seasons(wide.where(F.col("season") < DRIFT).drop("round_type", "winner"), path)
    files.write_seasons(wide.where(F.col("season") >= DRIFT), path)
    files.write_seasons(wide.where(F.col("season") == FIRST_SEASON + 1).drop("winner"), path)
    seasons = [files.read_seasons(spark, path, s, s, schema=wide.schema) for s in range(FIRST_SEASON, DRIFT + 2)]
    return files.union_by_name([*seasons, wide.where(F.col("season") == DRIFT + 2).drop("round_number")]).select(*wide.columns)


def named_summary(spark, sf_dir):
    """Five-statistic summary on normalised names."""
    return summary.entity_summary(
        roles.messy_names(spark, sf_dir), lambda df: clean.normalise_names(df, "entity", roles.MESSY_ALIASES))


def entity_summary(spark, sf_dir):
    return rounded(named_summary(spark, sf_dir))


def name_audit(spark, sf_dir):
    return rounded(clean.name_audit(named_summary(spark, sf_dir)))


def name_collisions(spark, sf_dir):
    return clean.colliding_spellings(roles.messy_names(spark, sf_dir), "entity", roles.MESSY_ALIASES)


def null_audit(spark, sf_dir):
    return clean.null_audit(clean.clean_observations(roles.raw_observations(spark, sf_dir)))


def appearance_number(spark, sf_dir):
    rows = inputs.observed(spark, sf_dir).select("date", "game", "entity", "group_name", "metric")
    return frame.appearance_number(materialise(frame.since(rows, inputs.START_DATE), "frame"))


def primary_role(spark, sf_dir):
    rows = frame.since(inputs.observed(spark, sf_dir, with_role=True), inputs.START_DATE)
    return frame.primary_role(rows, roles.ROLE_OF_TYPE)


def model_frame(spark, sf_dir):
    rows = inputs.observed(spark, sf_dir, with_role=True)
    return rounded(frame.model_frame(rows, roles.ROLE_OF_TYPE, inputs.START_DATE, inputs.MIN_ROWS))


def centred_frame(spark, sf_dir):
    return rounded(features.centred_frame(inputs.eligible_rows(spark, sf_dir)))


def entity_means_ranked(spark, sf_dir):
    return rounded(features.entity_means_ranked(inputs.eligible_rows(spark, sf_dir)))


def entity_checks(spark, sf_dir):
    return rounded(features.entity_checks(inputs.eligible_rows(spark, sf_dir)))


def recent_frame_rowz(spark, sf_dir):
    return rounded(features.recent_rowz(inputs.eligible_rows(spark, sf_dir), inputs.MIN_RECENT))


def recent_frame_entityz(spark, sf_dir):
    return rounded(features.recent_entityz(inputs.eligible_rows(spark, sf_dir), inputs.MIN_RECENT))


def entity_groups(spark, sf_dir):
    rows = inputs.observed(spark, sf_dir, group="status").select("date", "game", "entity", "group_name")
    return summary.with_current_group(materialise(rows, "frame"))


def metric_by_outcome(spark, sf_dir):
    return rounded(summary.metric_by_outcome(inputs.outcome_frame(spark, sf_dir)))


def ols_summary(spark, sf_dir):
    fit = linear.ols_summary(named_summary(spark, sf_dir), "n_contests", "mean_metric")
    return rounded(fit)


def ols_trial(spark, sf_dir):
    return rounded(linear.ols_trial(inputs.outcome_frame(spark, sf_dir), TRIAL))


def ols_interaction(spark, sf_dir):
    return rounded(linear.ols_interaction(inputs.outcome_frame(spark, sf_dir), inputs.MIN_ROWS))


def ols_reference(spark, sf_dir):
    """The same contrasts against chosen entities; groups without one keep their first."""
    return rounded(linear.ols_interaction(inputs.outcome_frame(spark, sf_dir), inputs.MIN_ROWS, reference=CHOSEN))


def ols_top(spark, sf_dir):
    terms = linear.ols_interaction(inputs.outcome_frame(spark, sf_dir), inputs.MIN_ROWS)
    best = ranking.top_with_ties(linear.only_interactions(terms), "group_name", "estimate", 1)
    return rounded(best.select("group_name", "entity", "term", "estimate", "std_error", "statistic"))


def plot_scatter_labels(spark, sf_dir):
    return rounded(plotdata.scatter_labels(named_summary(spark, sf_dir), 50, 27, 25, 60))


def plot_mean_sd(spark, sf_dir):
    checks = features.entity_checks(inputs.eligible_rows(spark, sf_dir))
    return rounded(plotdata.mean_sd_labels(checks, 25.5, 14.3, 26.2, 14.7))


def plot_density(spark, sf_dir):
    return rounded(plotdata.density(inputs.observed(spark, sf_dir).select("metric"), "metric"))


def plot_mean_density(spark, sf_dir):
    means = named_summary(spark, sf_dir).select("mean_metric")
    means = materialise(means, "means")
    overall = means.agg(F.avg("mean_metric")).first()[0]
    return rounded(plotdata.density(means, "mean_metric").withColumn("overall_mean", F.lit(overall)))


def recent_entities(spark, sf_dir):
    """Distinct (entity, group_name, metric_mean_z) of the recent frame."""
    cells = inputs.eligible_cells(spark, sf_dir)
    recent = features.recent_entityz(cells, inputs.MIN_RECENT, weight="n_rows")
    return recent.select("entity", "group_name", "metric_mean_z").distinct()


def plot_group_density(spark, sf_dir):
    entities = materialise(recent_entities(spark, sf_dir), "entities")
    return rounded(plotdata.density(entities, "metric_mean_z", ["group_name"]))


def line_slopes(spark, sf_dir):
    """Every eligible entity's own slope."""
    fits = linear.entity_fits(inputs.outcome_frame(spark, sf_dir), inputs.MIN_ROWS)
    return fits.select("entity", F.col("slope").alias("total_slope"))


def plot_top3_flags(spark, sf_dir):
    entities = materialise(recent_entities(spark, sf_dir), "entities")
    slopes = materialise(line_slopes(spark, sf_dir), "slopes")
    return rounded(plotdata.top3_points(entities, slopes))


def plot_slope_hist(spark, sf_dir):
    slopes = materialise(line_slopes(spark, sf_dir), "slopes")
    return rounded(plotdata.histogram(slopes, "total_slope"))


def plot_slope_breaks(spark, sf_dir):
    """The same slopes in bins with rounded breaks."""
    slopes = materialise(line_slopes(spark, sf_dir), "slopes")
    return rounded(plotdata.rounded_histogram(slopes, "total_slope"))


def line_effects(spark, sf_dir):
    """Slope, intercept and their sum of every eligible entity's own line."""
    fits = linear.entity_fits(inputs.outcome_frame(spark, sf_dir), inputs.MIN_ROWS).where("slope is not null")
    lines = fits.select("group_name", "entity", F.col("slope").alias("total_slope"), F.col("intercept").alias("total_intercept"))
    return materialise(lines.withColumn("total_effect", F.col("total_slope") + F.col("total_intercept")), "lines")


def line_ranking(spark, sf_dir):
    """The ten largest slopes."""
    return rounded(effects.slope_ranking(line_effects(spark, sf_dir), n=10))


def line_top3_slopes(spark, sf_dir):
    """Three largest slopes per group, ties kept."""
    return rounded(effects.top_slopes(line_effects(spark, sf_dir), 3))


def line_top3_effects(spark, sf_dir):
    """First three per group by total effect."""
    return rounded(effects.top_effects(line_effects(spark, sf_dir), 3))


def line_group_relative(spark, sf_dir):
    """Baselines relative to the group's mean, and the effect inside the group."""
    return rounded(effects.group_relative(line_effects(spark, sf_dir).drop("total_effect")))


def line_group_table(spark, sf_dir):
    """One group's entities, largest effect inside the group first."""
    relative = effects.group_relative(line_effects(spark, sf_dir).drop("total_effect"))
    return rounded(effects.group_table(relative, "ASIA").select("entity", "group_name", "intercept_std", "total_slope", "total_effect"))


def line_group_head(spark, sf_dir):
    """The ten largest effects inside one group."""
    relative = effects.group_relative(line_effects(spark, sf_dir).drop("total_effect"))
    return rounded(effects.group_table(relative, "MIDDLE EAST", 10).select("entity", "total_slope", "total_effect"))


def line_top3_subset(spark, sf_dir):
    """Entities that carry the top-3 flag."""
    flagged = ranking.flag_first_k(line_effects(spark, sf_dir), "group_name", "total_slope", 3)
    return rounded(flagged.where("top3").select("group_name", "entity", "total_slope"))


def line_predict_grid(spark, sf_dir):
    """Logistic curve along the metric for every line of one group."""
    return rounded(effects.predict_lines(line_effects(spark, sf_dir), "ASIA", [0, 10, 25, 40, 50]))


def appearance_join(spark, sf_dir):
    """Running number joined back by date and entity: two appearances on a date meet each other."""
    rows = materialise(inputs.outcome_frame(spark, sf_dir).select("date", "game", "entity", "group_name", "metric"), "frame")
    return frame.join_appearances(rows, frame.appearance_number(rows))


QUERIES = {f.__name__: f for f in (
    line_ranking, line_top3_slopes, line_top3_effects, line_group_relative, line_group_table, line_group_head, line_top3_subset,
    line_predict_grid, appearance_join,
    contest_winner, season_store, native_join, native_join_audit, clean_observations, recode_groups, group_names, join_contests, entity_summary, name_audit,
    name_collisions, null_audit, appearance_number, primary_role, model_frame, centred_frame, entity_means_ranked,
    entity_checks, recent_frame_rowz, recent_frame_entityz, entity_groups, metric_by_outcome, ols_summary,
    ols_trial, ols_interaction, ols_reference, ols_top, plot_scatter_labels, plot_mean_sd, plot_density, plot_mean_density,
    plot_group_density, plot_top3_flags, plot_slope_hist, plot_slope_breaks,
)}
