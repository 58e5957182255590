"""P-values of t and F statistics as JVM expressions (regularised incomplete beta function)."""

import math

from pyspark.sql import functions as F

from swayline.functions import normal

#: Degrees of freedom from which a t statistic is turned into a normal one (error below 1e-12).
NORMAL_FROM = 1e6
#: The log-gamma series is used from here on; smaller arguments are shifted by as much.
SHIFT = 10


def log_gamma(z):
    """log Gamma of a positive column, by Stirling's series behind a shift."""
    product = z
    for k in range(1, SHIFT):
        product = product * (z + k)
    w = z + SHIFT
    r = 1 / (w * w)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * F.lit(1 / 1680)))) / w
    low = (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)
    r = 1 / (z * z)  # no shift for large arguments, whose product would overflow
    high = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * F.lit(1 / 1260))) / z
    return F.when(z < 1e6, low).otherwise(high)


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function by modified Lentz steps; it needs about sqrt(max(a, b))."""
    def guarded(v):
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    first = 1 / guarded(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(state, numerator):
        d = 1 / guarded(1 + numerator * state["d"])
        c = guarded(1 + numerator / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    # both halves of a step get their numerators from arrays, so that no expression is repeated inside another
    steps = F.sequence(F.lit(1), (40 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))
    terms = F.flatten(F.transform(steps, lambda m: F.array(
        m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))))
    return F.aggregate(terms, start, half, lambda s: s["h"])


def with_upper(df, name, a, b, x, y):
    """Adds I_x(a, b) as ``name``; the arguments are double columns, ``y`` is 1 - x."""
    direct = F.col("__x") < (F.col("__a") + 1) / (F.col("__a") + F.col("__b") + 2)
    df = df.withColumns({"__a": a, "__b": b, "__x": x, "__y": y})
    df = df.withColumns({
        "__p": F.when(direct, F.col("__a")).otherwise(F.col("__b")), "__q": F.when(direct, F.col("__b")).otherwise(F.col("__a")),
        "__u": F.when(direct, F.col("__x")).otherwise(F.col("__y")), "__v": F.when(direct, F.col("__y")).otherwise(F.col("__x")),
        "__direct": direct,
    })
    p, q, u, v = (F.col(c) for c in ("__p", "__q", "__u", "__v"))
    beta = log_gamma(p) + log_gamma(q) - log_gamma(p + q)
    part = F.when(u <= 0, F.lit(0.0)).otherwise(F.exp(p * F.log(u) + q * F.log(v) - beta) / p * _fraction(p, q, u))
    df = df.withColumn("__part", F.when(u.isNotNull() & (p > 0), part))
    out = F.when(F.col("__direct"), F.col("__part")).otherwise(1 - F.col("__part"))
    return df.withColumn(name, F.greatest(out, F.lit(0.0) * out)).drop("__a", "__b", "__x", "__y", "__p", "__q", "__u", "__v", "__direct", "__part")


def with_t_p_value(df, name="p_value", statistic="statistic", freedom="df_residual"):
    """Adds the two-sided p-value of a t statistic; NULL without a statistic or degrees of freedom."""
    t, n = F.col(statistic), F.col(freedom).cast("double")
    square = t * t
    known = n.isNotNull() & (n > 0) & t.isNotNull() & ~F.isnan(t)
    few = known & (n < NORMAL_FROM)
    df = df.withColumn("__z", F.when(known & ~few, t * (1 - 1 / (4 * n)) / F.sqrt(1 + square / (2 * n))))
    df = with_upper(df, "__t", F.when(few, n / 2), F.when(few, F.lit(0.5)), F.when(few, n / (n + square)), F.when(few, square / (n + square)))
    return df.withColumn(name, F.coalesce("__t", F.expr(normal.two_sided("__z")))).drop("__t", "__z")


def with_f_p_value(df, name="f_p_value", statistic="f_statistic", above="df_model", below="df_residual"):
    """Adds P(F > statistic); NULL without a statistic or degrees of freedom."""
    f, m, n = F.col(statistic), F.col(above).cast("double"), F.col(below).cast("double")
    known = (n > 0) & (m > 0) & (f >= 0) & ~F.isnan(f)
    return with_upper(df, name, F.when(known, n / 2), F.when(known, m / 2), F.when(known, n / (n + m * f)), F.when(known, m * f / (n + m * f)))
