"""Model queries over the sample tables."""

from pyspark.sql import functions as F

from swayline.operators import bootstrap, controls, effects, features, fit_summary, frame, mixed, penalised, plotdata, probit, ranking
from swayline.plans import inputs
from swayline.plans.descriptive import CHOSEN, rounded
from swayline.scratch import materialise

Form = mixed.Form
SENSITIVITY = Form(group_fixed=True, entity_intercept=False)
MVP = Form()
FULL = dict(x="metric_centred_z", m="metric_mean_z")
#: Spreads of the fits that hold them.
GIVEN = {"sensitivity": {"sd_slope": 0.3}, "mvp": {"sd_intercept": 0.25, "sd_slope": 0.3}}


def recent_preferred(spark, sf_dir):
    """Latest two seasons with entity-level and within-entity z-scores, as cells."""
    cells = inputs.eligible_cells(spark, sf_dir)
    return materialise(features.recent_entityz(cells, inputs.MIN_RECENT, weight="n_rows"), "recent")


def recent_exploratory(spark, sf_dir):
    """Latest two seasons with z-scores over rows, as cells."""
    cells = inputs.eligible_cells(spark, sf_dir)
    return materialise(features.recent_rowz(cells, inputs.MIN_RECENT, weight="n_rows"), "recent")


def full_window(spark, sf_dir, group="region", min_rows=inputs.MIN_ROWS):
    """All seasons with z-scores over rows, as cells."""
    return materialise(features.full_rowz(inputs.eligible_cells(spark, sf_dir, group, min_rows), "n_rows"), "full")


def model_table(fit):
    """Fixed effects, spreads and fit statistics in one long table."""
    stats = fit.fit_stats.selectExpr(
        "stack(5, 'log_lik', log_lik, 'aic', aic, 'bic', bic, 'is_singular', cast(is_singular AS double), "
        "'converged', cast(converged AS double)) "
        "AS (term, estimate)")
    missing = [f"cast(NULL AS double) AS {c}" for c in ("std_error", "statistic", "p_value")]
    parts = [
        fit.coefficients.selectExpr("'fixed' AS part", "term", "estimate", "std_error", "statistic", "p_value"),
        fit.variance_components.selectExpr(
            "'spread' AS part", "concat(factor, ' ', term) AS term", "sd AS estimate",
            *missing),
        stats.selectExpr("'fit' AS part", "term", "estimate", *missing),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)


def probit_interaction(spark, sf_dir):
    return rounded(probit.probit_interaction(inputs.eligible_cells(spark, sf_dir)))


def probit_reference(spark, sf_dir):
    """The same contrasts against chosen entities; groups without one keep their first."""
    return rounded(probit.probit_interaction(inputs.eligible_cells(spark, sf_dir), reference=CHOSEN))


def probit_top(spark, sf_dir):
    terms = probit.probit_interaction(inputs.eligible_cells(spark, sf_dir))
    best = terms.where(F.col("term_kind") == "interaction")
    return rounded(ranking.top_with_ties(best, "group_name", "estimate", 1))


def probit_global(spark, sf_dir):
    cells = inputs.eligible_cells(spark, sf_dir, group="status", min_rows=inputs.MIN_ROWS // 2)
    return rounded(probit.probit_global(cells))


def probit_global_top(spark, sf_dir):
    """Largest interaction per group, ties kept; entities of several groups count in each."""
    cells = inputs.eligible_cells(spark, sf_dir)
    terms = probit.probit_global(cells).where(F.col("term_kind") == "interaction")
    joined = effects.with_groups(terms, cells)
    best = ranking.top_with_ties(joined, "group_name", "estimate", 1)
    return rounded(best).orderBy("group_name", "entity")


def glmm_sensitivity(spark, sf_dir):
    return model_table(mixed.fit_mixed(recent_preferred(spark, sf_dir), SENSITIVITY))


def sensitivity_effects(spark, sf_dir):
    recent = recent_preferred(spark, sf_dir)
    fit = mixed.fit_mixed(recent, SENSITIVITY)
    return recent, fit, materialise(effects.entity_effects(fit, SENSITIVITY), "effects")


def sensitivity_top3(spark, sf_dir):
    """Three largest total slopes per group: whose ups and downs move the outcome most."""
    recent, _, slopes = sensitivity_effects(spark, sf_dir)
    best = effects.top_slopes(effects.with_groups(slopes, recent), 3)
    return rounded(best.select("group_name", "entity", "slope", "total_slope"), 4).orderBy(
        "group_name", F.desc("total_slope"), "entity")


def glmm_mvp(spark, sf_dir):
    return model_table(mixed.fit_mixed(recent_preferred(spark, sf_dir), MVP))


def mvp_top3(spark, sf_dir):
    """Three largest total effects per group: baseline plus slope."""
    recent = recent_preferred(spark, sf_dir)
    fit = mixed.fit_mixed(recent, MVP)
    joined = effects.with_groups(effects.entity_effects(fit, MVP), recent)
    best = effects.top_effects(joined, 3)
    return rounded(best.select("group_name", "entity", "total_intercept", "total_slope", "total_effect"), 4)


def given_table(fit):
    """Fixed effects, log-likelihood and sizes of a fit at given spreads."""
    stats = fit.fit_stats.selectExpr(
        "'fit' AS part", "stack(3, 'log_lik', log_lik, 'n_obs', double(n_obs), 'n_entities', double(n_entities)) AS (term, estimate)",
        *[f"cast(NULL AS double) AS {c}" for c in ("std_error", "statistic", "p_value")])
    return rounded(fit.coefficients.select(F.lit("fixed").alias("part"), "term", "estimate", "std_error", "statistic", "p_value").unionByName(stats))


def given_sensitivity(spark, sf_dir):
    """The slope model at given spreads."""
    return given_table(penalised.fit_at_spreads(recent_preferred(spark, sf_dir), SENSITIVITY, GIVEN["sensitivity"]))


def given_mvp(spark, sf_dir):
    """Entity levels and slopes at given spreads."""
    return given_table(penalised.fit_at_spreads(recent_preferred(spark, sf_dir), MVP, GIVEN["mvp"]))


def given_top3(spark, sf_dir):
    """Three largest total slopes per group, at given spreads."""
    recent = recent_preferred(spark, sf_dir)
    slopes = effects.entity_effects(penalised.fit_at_spreads(recent, SENSITIVITY, GIVEN["sensitivity"]), SENSITIVITY)
    best = effects.top_slopes(effects.with_groups(slopes, recent), 3)
    return rounded(best.select("group_name", "entity", "slope", "total_slope"))


def given_relative(spark, sf_dir):
    """Totals, effects inside the group and recent row counts of every entity, at given spreads."""
    recent = recent_preferred(spark, sf_dir)
    table = effects.entity_effects(penalised.fit_at_spreads(recent, MVP, GIVEN["mvp"]), MVP)
    joined = materialise(effects.with_groups(table.drop("total_effect"), recent), "effects")
    counted = effects.with_counts(effects.group_relative(joined), recent.select("entity", "n_games").distinct())
    return rounded(counted.select("group_name", "entity", "total_intercept", "total_slope", "intercept_std", "total_effect", "n_games"))


def glmm_entity(spark, sf_dir):
    """Entity intercepts and slopes, no group term; effects ranked by slope."""
    form = Form(**FULL)
    table = effects.entity_effects(mixed.fit_mixed(full_window(spark, sf_dir), form), form)
    ranked = effects.slope_ranking(table.withColumn("total_effect", F.col("intercept") + F.col("total_slope")))
    return rounded(ranked.select("entity", "intercept", "total_slope", "total_effect"), 4)


def glmm_group_fe(spark, sf_dir):
    """Group fixed effects and entity slopes; ranked slopes."""
    form = Form(**FULL, group_fixed=True, entity_intercept=False)
    table = effects.entity_effects(mixed.fit_mixed(full_window(spark, sf_dir), form), form)
    return rounded(effects.slope_ranking(table).select("entity", "total_slope"), 4)


def glmm_group_fe_recent(spark, sf_dir):
    """The same on the latest two seasons, with the entities' row counts."""
    form = Form(**FULL, group_fixed=True, entity_intercept=False)
    recent = recent_exploratory(spark, sf_dir)
    table = effects.entity_effects(mixed.fit_mixed(recent, form), form)
    counted = effects.with_counts(table, recent.select("entity", "n_games").distinct())
    return rounded(effects.slope_ranking(counted).select("entity", "total_slope", "n_games"), 4)


def glmm_entity_recent(spark, sf_dir):
    form = Form(**FULL)
    table = effects.entity_effects(mixed.fit_mixed(recent_exploratory(spark, sf_dir), form), form)
    return rounded(table.select("entity", "total_intercept", "total_slope"), 4)


def relative_effects(spark, sf_dir):
    form = Form(**FULL)
    recent = recent_exploratory(spark, sf_dir)
    table = effects.entity_effects(mixed.fit_mixed(recent, form), form)
    joined = materialise(effects.with_groups(table.drop("total_effect"), recent), "effects")
    return effects.group_relative(joined)


def group_relative_effects(spark, sf_dir):
    """Effects inside the group, flagged where they are the group's largest slope or baseline."""
    table = materialise(relative_effects(spark, sf_dir), "relative")
    slope = ranking.top_with_ties(table, "group_name", "total_slope", 1).select(
        "group_name", "entity", F.lit(True).alias("top_slope"))
    level = ranking.top_with_ties(table, "group_name", "intercept_std", 1).select(
        "group_name", "entity", F.lit(True).alias("top_intercept"))
    joined = table.join(slope, ["group_name", "entity"], "left").join(level, ["group_name", "entity"], "left")
    return rounded(joined.select(
        "group_name", "entity", "total_intercept", "total_slope", "intercept_std", "total_effect",
        F.coalesce("top_slope", F.lit(False)).alias("top_slope"),
        F.coalesce("top_intercept", F.lit(False)).alias("top_intercept")), 4)


def plot_baseline_slope(spark, sf_dir):
    """Baseline against slope of one group's entities, largest total effect first."""
    table = effects.group_table(relative_effects(spark, sf_dir), "ASIA")
    return rounded(table.select("entity", "group_name", "intercept_std", "total_slope", "total_effect"), 4)


def glmm_crossed_raw(spark, sf_dir):
    form = Form(x="metric", m=None, group_random=True)
    return model_table(mixed.fit_mixed(inputs.eligible_cells(spark, sf_dir), form))


def glmm_crossed_centred(spark, sf_dir):
    form = Form(x="metric_centred", m="metric_mean", group_random=True)
    return model_table(mixed.fit_mixed(full_window(spark, sf_dir), form))


def glmm_crossed_z(spark, sf_dir):
    return model_table(mixed.fit_mixed(full_window(spark, sf_dir), Form(**FULL, group_random=True)))


def glmm_nested(spark, sf_dir):
    """Entities nested in groups; line status as the group, so that entities have several."""
    cells = full_window(spark, sf_dir, "status", inputs.MIN_ROWS // 2)
    return model_table(mixed.fit_mixed(cells, Form(**FULL, group_random=True, nested=True)))


def model_diagnostics(spark, sf_dir):
    """Singularity, spreads and fit of both preferred models."""
    recent = recent_preferred(spark, sf_dir)
    tables = []
    for name, form in (("sensitivity", SENSITIVITY), ("mvp", MVP)):
        fit = mixed.fit_mixed(recent, form)
        stats = fit.fit_stats.select(
            F.lit(name).alias("model"), "n_obs", "n_entities", "log_lik", "aic", "bic", "is_singular", "converged", "fit")
        tables.append(stats.join(fit.variance_components, "fit").drop("fit"))
    return rounded(tables[0].unionByName(tables[1]), 4)


def model_summary(spark, sf_dir):
    """Correlations of the fixed effects and quantiles of the scaled residuals of both preferred models."""
    recent = recent_preferred(spark, sf_dir)
    tables = [fit_summary.fit_summary(recent, mixed.fit_mixed(recent, form), form).select(F.lit(name).alias("model"), "*")
              for name, form in (("sensitivity", SENSITIVITY), ("mvp", MVP))]
    return rounded(tables[0].unionByName(tables[1]), 4)


def given_summary(spark, sf_dir):
    """The same of entity levels and slopes at given spreads."""
    recent = recent_preferred(spark, sf_dir)
    return rounded(fit_summary.fit_summary(recent, penalised.fit_at_spreads(recent, MVP, GIVEN["mvp"]), MVP))


def plot_model_slopes(spark, sf_dir):
    """Histogram of the slope model's total slopes."""
    _, _, slopes = sensitivity_effects(spark, sf_dir)
    return rounded(plotdata.histogram(slopes, "total_slope"), 4)


def plot_model_top3(spark, sf_dir):
    """Entities by group with the slope model's top-3 flags."""
    recent, _, slopes = sensitivity_effects(spark, sf_dir)
    entities = materialise(recent.select("entity", "group_name", "metric_mean_z").distinct(), "entities")
    return rounded(plotdata.top3_points(entities, slopes.select("entity", "total_slope")), 4)


def boot_slopes(spark, sf_dir, replicates=1000):
    recent, fit, _ = sensitivity_effects(spark, sf_dir)
    return rounded(bootstrap.bootstrap_slopes(recent, fit, SENSITIVITY, replicates), 4)


def predict_grid(spark, sf_dir):
    recent, fit, slopes = sensitivity_effects(spark, sf_dir)
    joined = effects.with_groups(slopes, recent)
    return rounded(effects.predict_grid(joined, fit, SENSITIVITY, "ASIA", [-2, -1, 0, 1, 2]), 4)


def glm_controls(spark, sf_dir):
    rows = inputs.outcome_frame(spark, sf_dir).select(
        "date", "game", "entity", "group_name", "metric", "outcome", "final")
    numbered = frame.appearance_number(materialise(rows, "frame"))
    return rounded(controls.logit_controls(numbered))


QUERIES = {f.__name__: f for f in (
    probit_interaction, probit_reference, probit_top, probit_global, probit_global_top, glmm_sensitivity, sensitivity_top3, glmm_mvp,
    mvp_top3, given_sensitivity, given_mvp, given_top3, given_relative, given_summary, model_summary, glmm_entity, glmm_group_fe, glmm_group_fe_recent, glmm_entity_recent, group_relative_effects,
    plot_baseline_slope, glmm_crossed_raw, glmm_crossed_centred, glmm_crossed_z, glmm_nested, model_diagnostics,
    plot_model_slopes, plot_model_top3, boot_slopes, predict_grid, glm_controls,
)}
