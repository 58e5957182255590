"""Closed-form regressions from grouped sums."""

from pyspark.sql import functions as F

from swayline.functions.student import with_f_p_value, with_t_p_value
from swayline.scratch import materialise


#: What a model's rows carry of the model itself.
MODEL_TESTS = ("df_residual", "r_squared", "adj_r_squared", "f_statistic", "f_p_value")


def _with_tests(terms):
    return terms.withColumn("statistic", F.try_divide("estimate", "std_error"))


def with_fit_tests(models):
    """Adds adjusted R2, the F statistic against the constant model and its p-value.

    Needs r_squared, df_model (slopes and contrasts) and df_residual, one row for each model.
    """
    left = 1 - F.col("r_squared")
    below = F.col("df_residual").cast("double")
    tested = models.withColumns({
        "adj_r_squared": F.when(below > 0, 1 - left * (F.col("df_model") + below) / below),
        "f_statistic": F.try_divide(F.col("r_squared") / F.when(F.col("df_model") > 0, F.col("df_model")), F.try_divide(left, below)),
    })
    return with_f_p_value(tested).drop("df_model")


def ols_summary(df, x, y):
    """Simple regression y ~ x: one row per term, with the fit's statistics on each row."""
    s = df.agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_avgx(F.col(y), F.col(x)).alias("avgx"),
        F.regr_sxx(F.col(y), F.col(x)).alias("sxx"),
        F.regr_sxy(F.col(y), F.col(x)).alias("sxy"),
        F.regr_syy(F.col(y), F.col(x)).alias("syy"),
    )
    s = s.withColumn("df_residual", F.col("n") - 2).withColumn(
        "sigma2", F.try_divide(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"), "df_residual")
    )
    terms = F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate"),
                 F.sqrt(F.col("sigma2") * (F.try_divide(F.lit(1.0), "n")
                                           + F.try_divide(F.col("avgx") * F.col("avgx"), "sxx"))).alias("std_error")),
        F.struct(F.lit(x).alias("term"), F.col("slope").alias("estimate"),
                 F.sqrt(F.try_divide("sigma2", "sxx")).alias("std_error")),
    )
    s = with_fit_tests(s.withColumns({
        "r_squared": F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")), "df_model": F.lit(1)}))
    long = s.select(
        F.inline(terms),
        "n", "df_residual", F.sqrt("sigma2").alias("sigma"), "r_squared", "adj_r_squared", "f_statistic", "f_p_value",
    )
    return with_t_p_value(_with_tests(long))


def entity_fits(frame, min_rows=1):
    """One least-squares line per (group_name, entity), from a single aggregate.

    Eligibility is counted at the same grain, so it needs no join back to the rows.
    """
    y, x = F.col("outcome"), F.col("metric")
    fits = frame.groupBy("group_name", "entity").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("line_intercept"),
        F.regr_avgx(y, x).alias("avgx"),
        F.regr_avgy(y, x).alias("avgy"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )
    sloped = F.col("sxx") > 0
    return fits.where((F.col("n_rows") >= min_rows) & (F.col("n") > 0)).select(
        "group_name", "entity", "n", "avgx", "sxx", "syy", "avgy",
        F.when(sloped, F.col("slope")).alias("slope"),
        F.when(sloped, F.col("line_intercept")).otherwise(F.col("avgy")).alias("intercept"),
        F.when(sloped, F.col("syy") - F.col("sxy") * F.col("sxy") / F.when(sloped, F.col("sxx")))
        .otherwise(F.col("syy")).alias("rss"),
        F.when(sloped, 2).otherwise(1).alias("n_params"),
    )


def level_key(entity, reference=(), collate=None):
    """Sort key of the levels of ``entity``: those listed in ``reference`` first, in its order, then by name.

    ``collate`` maps the name column to what names are ordered by (their binary order else); equal ones go by name.
    """
    listed = [reference] if isinstance(reference, str) else list(reference)
    place = F.array_position(F.array(*[F.lit(r) for r in listed]), entity) if listed else F.lit(0)
    key = F.struct(
        F.when(place > 0, place).otherwise(len(listed) + 1).cast("long").alias("place"),
        (collate(entity) if collate else entity).alias("collated"), entity.alias("entity"))
    return F.when(entity.isNotNull(), key)


def interaction_terms(fits, reference=(), collate=None):
    """Coefficients of outcome ~ metric * entity inside every group.

    The model is saturated by entity, so each contrast is a difference of two lines; the
    residual variance is pooled over the group. The reference is the group's first entity
    (see ``level_key``) whose metric varies. Groups are reduced by an aggregate and joined back, so a
    group with very many entities is never gathered in one task. The lines are written first,
    as both sides of that join need them and the rows behind them should be read once.
    """
    fits = materialise(fits, "fits")
    usable = F.when(F.col("slope").isNotNull(), level_key(F.col("entity"), reference, collate))
    line = F.struct("slope", "intercept", "avgx", "sxx", "n")
    groups = fits.groupBy("group_name").agg(
        F.sum("rss").alias("rss"), (F.sum("n") - F.sum("n_params")).alias("df_residual"), (F.sum("n_params") - 1).alias("df_model"),
        # squares about the group's mean: inside the entities, and between them
        (F.sum("syy") + F.sum(F.col("n") * F.col("avgy") * F.col("avgy"))
         - F.sum(F.col("n") * F.col("avgy")) * F.sum(F.col("n") * F.col("avgy")) / F.sum("n")).alias("tss"),
        F.min(usable)["entity"].alias("reference_entity"), F.min_by(line, usable).alias("ref"),
    )
    s2 = F.when(F.col("df_residual") > 0, F.try_divide(F.col("rss"), F.col("df_residual").cast("double")))
    groups = groups.withColumn("s2", s2).withColumn("r_squared", 1 - F.try_divide("rss", F.when(F.col("tss") > 0, F.col("tss"))))
    joined = fits.drop("rss", "n_params").join(with_fit_tests(groups), "group_name")

    def variances(prefix):
        inv = F.try_divide(F.lit(1.0), f"{prefix}sxx")
        at_zero = F.coalesce(F.col(f"{prefix}avgx") * F.col(f"{prefix}avgx") * inv, F.lit(0.0))
        return F.col("s2") * inv, F.col("s2") * (F.try_divide(F.lit(1.0), f"{prefix}n") + at_zero)

    own, ref = variances(""), variances("ref.")
    return with_t_p_value(contrast_terms(joined.select(
        "group_name", "entity", "reference_entity", *MODEL_TESTS, "slope", "intercept",
        own[0].alias("var_slope"), own[1].alias("var_intercept"),
        F.col("ref.slope").alias("ref_slope"), F.col("ref.intercept").alias("ref_intercept"),
        ref[0].alias("ref_var_slope"), ref[1].alias("ref_var_intercept"),
    )))


def contrast_terms(lines):
    """Treatment-coded coefficients from one line per entity and its group's reference line."""
    def term(kind, label, estimate, variance):
        return F.struct(
            F.lit(kind).alias("term_kind"), label.alias("term"), estimate.alias("estimate"),
            F.sqrt(variance).alias("std_error"),
        )

    slope, level = F.col("slope"), F.col("intercept")
    own = F.array(
        term("intercept", F.lit("(Intercept)"), level, F.col("var_intercept")),
        term("metric", F.lit("metric"), slope, F.col("var_slope")),
    )
    others = F.array(
        term("entity", F.concat(F.lit("entity"), "entity"), level - F.col("ref_intercept"),
             F.col("var_intercept") + F.col("ref_var_intercept")),
        term("interaction", F.concat(F.lit("metric:entity"), "entity"), slope - F.col("ref_slope"),
             F.col("var_slope") + F.col("ref_var_slope")),
    )
    kept = [c for c in (*MODEL_TESTS, "separated") if c in lines.columns]
    terms = lines.where(F.col("reference_entity").isNotNull()).select(
        "group_name", "entity", "reference_entity", *kept,
        F.inline(F.when(F.col("entity") == F.col("reference_entity"), own).otherwise(others)),
    )
    return _with_tests(terms)


def only_interactions(terms):
    """Interaction rows; the entity is read off the term."""
    return terms.where(F.col("term_kind") == "interaction").withColumn(
        "entity", F.regexp_replace("term", "^metric:entity", "")
    )


def ols_interaction(frame, min_rows=30, reference=(), collate=None):
    """All coefficients of outcome ~ metric * entity, per group."""
    return interaction_terms(entity_fits(frame, min_rows), reference, collate)


def ols_trial(frame, entities, min_rows=1, reference=(), collate=None):
    """The interaction model on chosen entities as one group."""
    chosen = frame.where(F.col("entity").isin(list(entities))).withColumn("group_name", F.lit("all"))
    return ols_interaction(chosen, min_rows, reference, collate)
