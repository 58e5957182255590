"""Fitted models as plain SQL text: one recursive step per Newton step, written independently of the operators."""

from swayline.plans.inputs import MIN_ROWS
from swayline.plans.models import GIVEN
from swayline.plans.oracle import CHOSEN_FIRST, ELIGIBLE, FRAME, RECENT_ENTITY

STEPS = 14


def _phi(x):
    """Normal distribution function by its series around zero, for |x| of at most 7."""
    square, series = f"({x}) * ({x})", "1.0"
    for odd in range(181, 1, -2):
        series = f"(1 + {square} / {odd} * {series})"
    return f"(0.5 + exp(-0.5 * {square}) / sqrt(2 * pi()) * ({x}) * {series})"


def _two_sided(z):
    return f"CASE WHEN abs({z}) > 6.5 THEN 0.0 WHEN {z} IS NOT NULL THEN 2 * (1 - {_phi(f'abs({z})')}) END"


def _round(name, expression=None, digits=6):
    return f"round({expression or name}, {digits}) + 0.0 AS {name}"


# one probit line for each (group, entity): lines(group_name, entity, slope, intercept, var_slope, var_intercept, separated)
LINES = ELIGIBLE + f""",
cells AS (
  SELECT group_name, entity, metric, count(outcome) AS trials, sum(outcome) AS wins
  FROM rows WHERE metric IS NOT NULL GROUP BY ALL HAVING count(outcome) > 0),
shape AS (
  SELECT group_name, entity, sum(trials * metric) / sum(trials) AS mean, max(metric) - min(metric) AS width,
         min(metric) FILTER (wins > 0) AS w0, max(metric) FILTER (wins > 0) AS w1,
         min(metric) FILTER (wins < trials) AS l0, max(metric) FILTER (wins < trials) AS l1
  FROM cells GROUP BY ALL),
told AS (SELECT *, coalesce(w0 IS NULL OR l0 IS NULL OR l1 <= w0 OR w1 <= l0, true) AS separated FROM shape),
scaled AS (
  SELECT group_name, entity, (metric - mean) / width AS x, trials, wins
  FROM cells JOIN told USING (group_name, entity) WHERE width > 0 AND NOT separated),
newton AS (
  SELECT 0 AS step, group_name, entity, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS i0, 0.0::DOUBLE AS i1, 0.0::DOUBLE AS i2
  FROM told WHERE width > 0 AND NOT separated
  UNION ALL
  SELECT step + 1, group_name, entity, a + (o2 * s0 - o1 * s1) / (o0 * o2 - o1 * o1), b + (o0 * s1 - o1 * s0) / (o0 * o2 - o1 * o1), j0, j1, j2
  FROM (
    SELECT step, group_name, entity, a, b, sum(s) AS s0, sum(s * x) AS s1, sum(o) AS o0, sum(o * x) AS o1, sum(o * x * x) AS o2,
           sum(i) AS j0, sum(i * x) AS j1, sum(i * x * x) AS j2
    FROM (
      SELECT *, wins * won - (trials - wins) * lost AS s, wins * won * (won + eta) + (trials - wins) * lost * (lost - eta) AS o, trials * won * lost AS i
      FROM (
        SELECT *, d / p AS won, d / (1 - p) AS lost
        FROM (
          SELECT *, {_phi('eta')} AS p, exp(-0.5 * eta * eta) / sqrt(2 * pi()) AS d
          FROM (SELECT n.step, n.a, n.b, c.*, n.a + n.b * c.x AS eta
                FROM newton n JOIN scaled c ON c.group_name = n.group_name AND c.entity = n.entity WHERE n.step < {STEPS}))))
    GROUP BY step, group_name, entity, a, b)),
lines AS (
  SELECT t.group_name, t.entity, b / width AS slope, a - b * mean / width AS intercept, i0 / (i0 * i2 - i1 * i1) / (width * width) AS var_slope,
         (i2 + mean / width * mean / width * i0 + 2 * mean / width * i1) / (i0 * i2 - i1 * i1) AS var_intercept, separated
  FROM told t LEFT JOIN newton n ON n.group_name = t.group_name AND n.entity = t.entity AND step = {STEPS})"""

CONTRASTS = """,
first AS (SELECT group_name, min(entity) FILTER (slope IS NOT NULL) AS reference_entity FROM lines GROUP BY group_name),
ref AS (
  SELECT f.*, l.slope AS r_slope, l.intercept AS r_intercept, l.var_slope AS r_var_slope, l.var_intercept AS r_var_intercept
  FROM first f JOIN lines l ON l.group_name = f.group_name AND l.entity = f.reference_entity),
both_sides AS (SELECT l.*, ref.* EXCLUDE (group_name) FROM lines l JOIN ref ON ref.group_name = l.group_name),
terms AS (
  SELECT group_name, entity, reference_entity, separated, 'intercept' AS term_kind, '(Intercept)' AS term, intercept AS estimate, sqrt(var_intercept) AS std_error
  FROM both_sides WHERE entity = reference_entity
  UNION ALL SELECT group_name, entity, reference_entity, separated, 'metric', 'metric', slope, sqrt(var_slope) FROM both_sides WHERE entity = reference_entity
  UNION ALL SELECT group_name, entity, reference_entity, separated, 'entity', 'entity' || entity, intercept - r_intercept, sqrt(var_intercept + r_var_intercept)
  FROM both_sides WHERE entity <> reference_entity
  UNION ALL SELECT group_name, entity, reference_entity, separated, 'interaction', 'metric:entity' || entity, slope - r_slope, sqrt(var_slope + r_var_slope)
  FROM both_sides WHERE entity <> reference_entity)"""

COLUMNS = (f"{_round('estimate')}, {_round('std_error')}, round(estimate / std_error, 6) + 0.0 AS statistic, "
           f"round({_two_sided('(estimate / std_error)')}, 6) + 0.0 AS p_value")

# Where every entity has one group, the lines of the whole-data model are the same; all refer to one entity.
GLOBAL = """,
ref AS (SELECT entity AS reference_entity, slope AS r_slope, var_slope AS r_var_slope FROM lines WHERE slope IS NOT NULL ORDER BY entity LIMIT 1),
terms AS (
  SELECT group_name, 'interaction' AS term_kind, 'metric:entity' || entity AS term, entity, reference_entity, slope - r_slope AS estimate,
         sqrt(var_slope + r_var_slope) AS std_error FROM lines, ref WHERE entity <> reference_entity)"""

# The whole-data model over two groups that share entities: each entity has a level and a slope, the second group an offset.
BY_STATUS = FRAME.replace("entity, group_name, l_linestatus AS status", "entity, l_linestatus AS group_name, l_linestatus AS status")
SHARED = BY_STATUS + f""",
rows AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity, group_name) AS n_pair FROM frame) WHERE n_pair >= {MIN_ROWS // 2}),
cells AS (
  SELECT entity, (group_name = (SELECT max(group_name) FROM rows))::DOUBLE AS z, metric, count(outcome) AS trials, sum(outcome) AS wins
  FROM rows WHERE metric IS NOT NULL GROUP BY ALL HAVING count(outcome) > 0),
shape AS (
  SELECT entity, sum(trials * metric) / sum(trials) AS mean, max(metric) - min(metric) AS width,
         min(metric) FILTER (wins > 0) AS w0, max(metric) FILTER (wins > 0) AS w1,
         min(metric) FILTER (wins < trials) AS l0, max(metric) FILTER (wins < trials) AS l1
  FROM cells GROUP BY ALL),
told AS (SELECT *, coalesce(w0 IS NULL OR l0 IS NULL OR l1 <= w0 OR w1 <= l0, true) AS separated FROM shape),
scaled AS (
  SELECT entity, z, (metric - mean) / width AS x, trials, wins FROM cells JOIN told USING (entity) WHERE width > 0 AND NOT separated),
newton AS (
  SELECT 0 AS step, entity, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS g, 0.0::DOUBLE AS i0, 0.0::DOUBLE AS i1, 0.0::DOUBLE AS i2,
         0.0::DOUBLE AS iz, 0.0::DOUBLE AS izx FROM told WHERE width > 0 AND NOT separated
  UNION ALL
  SELECT step + 1, entity, a + (o2 * s0 - o1 * s1) / d - p0 * dg, b + (o0 * s1 - o1 * s0) / d - p1 * dg, g + dg, j0, j1, j2, jz, jzx
  FROM (
    SELECT *, sum(sz - p0 * s0 - p1 * s1) OVER (PARTITION BY step) / sum(oz - oz * p0 - ozx * p1) OVER (PARTITION BY step) AS dg
    FROM (
      SELECT *, (o2 * oz - o1 * ozx) / d AS p0, (o0 * ozx - o1 * oz) / d AS p1
      FROM (
        SELECT *, o0 * o2 - o1 * o1 AS d
        FROM (
          SELECT step, entity, a, b, g, sum(s) AS s0, sum(s * x) AS s1, sum(s * z) AS sz, sum(o) AS o0, sum(o * x) AS o1, sum(o * x * x) AS o2,
                 sum(o * z) AS oz, sum(o * z * x) AS ozx, sum(i) AS j0, sum(i * x) AS j1, sum(i * x * x) AS j2, sum(i * z) AS jz, sum(i * z * x) AS jzx
          FROM (
            SELECT *, wins * won - (trials - wins) * lost AS s, wins * won * (won + eta) + (trials - wins) * lost * (lost - eta) AS o, trials * won * lost AS i
            FROM (
              SELECT *, d / p AS won, d / (1 - p) AS lost
              FROM (
                SELECT *, {_phi('eta')} AS p, exp(-0.5 * eta * eta) / sqrt(2 * pi()) AS d
                FROM (SELECT n.step, n.a, n.b, n.g, c.*, n.a + n.g * c.z + n.b * c.x AS eta FROM newton n JOIN scaled c ON c.entity = n.entity WHERE n.step < {STEPS}))))
          GROUP BY step, entity, a, b, g))))),
ended AS (
  SELECT t.entity, b / width AS slope, a - b * mean / width AS level, g, (i2 + 2 * mean / width * i1 + mean / width * mean / width * i0) / d AS own_level,
         i0 / d / (width * width) AS own_slope, (i2 * iz - i1 * izx - mean / width * (i0 * izx - i1 * iz)) / d AS pull_level,
         (i0 * izx - i1 * iz) / d / width AS pull_slope, iz - (iz * (i2 * iz - i1 * izx) + izx * (i0 * izx - i1 * iz)) / d AS part
  FROM (SELECT *, i0 * i2 - i1 * i1 AS d FROM newton WHERE step = {STEPS}) n JOIN told t ON t.entity = n.entity),
v AS (SELECT 1 / sum(part) AS v FROM ended),
ref AS (SELECT entity AS reference_entity, slope AS r_slope, level AS r_level, own_level AS r_own_level, own_slope AS r_own_slope,
               pull_level AS r_pull_level, pull_slope AS r_pull_slope FROM ended ORDER BY entity LIMIT 1),
both_sides AS (SELECT * FROM ended, ref, v),
terms AS (
  SELECT 'intercept' AS term_kind, '(Intercept)' AS term, NULL AS entity, level AS estimate, sqrt(own_level + pull_level * pull_level * v) AS std_error
  FROM both_sides WHERE entity = reference_entity
  UNION ALL SELECT 'metric', 'metric', entity, slope, sqrt(own_slope + pull_slope * pull_slope * v) FROM both_sides WHERE entity = reference_entity
  UNION ALL SELECT 'group', 'group_name' || (SELECT max(group_name) FROM rows), NULL, g, sqrt(v) FROM both_sides WHERE entity = reference_entity
  UNION ALL SELECT 'entity', 'entity' || entity, entity, level - r_level, sqrt(own_level + r_own_level + power(pull_level - r_pull_level, 2) * v)
  FROM both_sides WHERE entity <> reference_entity
  UNION ALL SELECT 'interaction', 'metric:entity' || entity, entity, slope - r_slope, sqrt(own_slope + r_own_slope + power(pull_slope - r_pull_slope, 2) * v)
  FROM both_sides WHERE entity <> reference_entity
  UNION ALL SELECT 'interaction', 'metric:entity' || entity, entity, NULL, NULL FROM told WHERE separated OR width = 0)"""


def _solved(names, source, keep, cross=()):
    """SELECT of the solution u_0.. of the symmetric system h_i_j u = g_i, of its inverse's diagonal v_0.. and entries w_i_j, by elimination."""
    n = len(names)
    cells = {(i, j): f"h_{min(i, j)}_{max(i, j)}" for i in range(n) for j in range(n)}
    columns = [f"{cells[i, j]} AS m_{i}_{j}" for i in range(n) for j in range(n)]
    columns += [f"g_{i} AS m_{i}_{n}" for i in range(n)] + [f"{float(i == j)}::DOUBLE AS m_{i}_{n + 1 + j}" for i in range(n) for j in range(n)]
    text = f"SELECT {keep}, {', '.join(columns)} FROM ({source})"
    for p in range(n):  # Gauss-Jordan: row p is scaled, the others lose their multiple of it
        columns = [f"m_{p}_{j} / m_{p}_{p} AS m_{p}_{j}" if i == p else f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p} AS m_{i}_{j}"
                   for i in range(n) for j in range(2 * n + 1)]
        text = f"SELECT {keep}, {', '.join(columns)} FROM ({text})"
    out = [f"m_{i}_{n} AS u_{i}, m_{i}_{n + 1 + i} AS v_{i}" for i in range(n)] + [f"m_{i}_{n + 1 + j} AS w_{i}_{j}" for i, j in cross]
    return f"SELECT {keep}, {', '.join(out)} FROM ({text})"


def _logit(predictors, scales):
    """Newton steps of a logistic regression on ``design`` (predictors, trials, wins); fitted(term, estimate, std_error)."""
    n = len(predictors) + 1
    x = ["1.0", *(f"({p} / {s})" for p, s in zip(predictors, scales))]
    eta = " + ".join(f"b_{i} * {x[i]}" for i in range(n))
    sums = [f"sum((wins - trials * p) * {x[i]}) AS g_{i}" for i in range(n)]
    sums += [f"sum(trials * p * (1 - p) * {x[i]} * {x[j]}) AS h_{i}_{j}" for i in range(n) for j in range(i, n)]
    now = ", ".join(f"b_{i}" for i in range(n))
    summed = f"""SELECT step, {now}, {', '.join(sums)} FROM (
      SELECT s.*, d.*, 1 / (1 + exp(-({eta}))) AS p FROM steps s, design d WHERE step < {STEPS}) GROUP BY step, {now}"""
    start = ", ".join(f"0.0::DOUBLE AS b_{i}, 0.0::DOUBLE AS v_{i}" for i in range(n))
    moved = ", ".join(f"b_{i} + u_{i}, v_{i}" for i in range(n))
    names = ["(Intercept)", *predictors]
    out = " UNION ALL ".join(
        f"SELECT '{name}' AS term, b_{i} / {s} AS estimate, sqrt(v_{i}) / {s} AS std_error FROM steps WHERE step = {STEPS}"
        for i, (name, s) in enumerate(zip(names, [1.0, *scales])))
    return f"""steps AS (
  SELECT 0 AS step, {start} UNION ALL SELECT step + 1, {moved} FROM ({_solved(names, summed, f"step, {now}")})),
fitted AS ({out})"""


def _penalised(columns, sd_slope, sd_intercept=None):
    """Newton steps of a mixed logistic model at given spreads on ``design`` (entity, x, trials, wins and the columns' own).

    A row of ``steps`` is an entity with its two terms (za, zb) and the coefficients b_j of all ``columns``. The entity's
    terms are solved for first (v00, v01, v11 is the inverse of their information), then all entities' rests are added up.
    """
    n, slope = len(columns), 1 / sd_slope**2
    level = 1 / sd_intercept**2 if sd_intercept else 0.0
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    cross = [(i, j) for i, j in cells if i < j]
    now = "step, entity, za, zb, " + ", ".join(f"b_{i}" for i in range(n))
    eta = " + ".join(f"b_{i} * ({c})" for i, c in enumerate(columns)) + " + za + zb * x"
    sums = ["sum(wins * eta - trials * ln(1 + exp(eta))) AS ll", "sum(s) AS s0", "sum(s * x) AS s1", "sum(o) AS o0", "sum(o * x) AS o1", "sum(o * x * x) AS o2"]
    for i, c in enumerate(columns):
        sums += [f"sum(s * ({c})) AS y_{i}", f"sum(o * ({c})) AS p_{i}", f"sum(o * x * ({c})) AS q_{i}"]
    sums += [f"sum(o * ({columns[i]}) * ({columns[j]})) AS k_{i}_{j}" for i, j in cells]
    each = f"""SELECT {now}, {', '.join(sums)} FROM (
      SELECT *, wins - trials * p AS s, trials * p * (1 - p) AS o FROM (
        SELECT *, 1 / (1 + exp(-eta)) AS p FROM (
          SELECT n.*, c.* EXCLUDE (entity), {eta} AS eta FROM steps n JOIN design c ON c.entity = n.entity WHERE n.step < {STEPS}))) GROUP BY {now}"""
    if sd_intercept:
        inverse = f"(o2 + {slope}) / d AS v00, -o1 / d AS v01, (o0 + {level}) / d AS v11, ln(d / {level * slope}) AS log_det"
        inverse = f"SELECT *, {inverse} FROM (SELECT *, (o0 + {level}) * (o2 + {slope}) - o1 * o1 AS d FROM ({each}))"
    else:
        inverse = f"SELECT *, 0.0 AS v00, 0.0 AS v01, 1 / (o2 + {slope}) AS v11, ln((o2 + {slope}) / {slope}) AS log_det FROM ({each})"
    own = f"""SELECT *, v00 * (s0 - {level} * za) + v01 * (s1 - {slope} * zb) AS e0, v01 * (s0 - {level} * za) + v11 * (s1 - {slope} * zb) AS e1,
      ll - ({level} * za * za + {slope} * zb * zb + log_det) / 2 AS part FROM ({inverse})"""
    rests = [f"sum(y_{i} - p_{i} * e0 - q_{i} * e1) OVER (PARTITION BY step) AS g_{i}" for i in range(n)]
    rests += [f"sum(k_{i}_{j} - p_{i} * (v00 * p_{j} + v01 * q_{j}) - q_{i} * (v01 * p_{j} + v11 * q_{j})) OVER (PARTITION BY step) AS h_{i}_{j}" for i, j in cells]
    keep = f"{now}, e0, e1, v00, v01, v11, lik, " + ", ".join(f"p_{i}, q_{i}" for i in range(n))
    summed = f"SELECT {keep}, {', '.join(f'g_{i}' for i in range(n))}, {', '.join(f'h_{i}_{j}' if i < j else f'CASE WHEN h_{i}_{j} = 0 THEN 1 ELSE h_{i}_{j} END AS h_{i}_{j}' for i, j in cells)} FROM (" \
             f"SELECT *, sum(part) OVER (PARTITION BY step) AS lik, {', '.join(rests)} FROM ({own}))"
    pull = [" + ".join(f"({v} * p_{i} + {w} * q_{i}) * u_{i}" for i in range(n)) for v, w in (("v00", "v01"), ("v01", "v11"))]
    start = ", ".join(f"0.0::DOUBLE AS b_{i}, 0.0::DOUBLE AS v_{i}" for i in range(n)) + "".join(f", 0.0::DOUBLE AS w_{i}_{j}" for i, j in cross)
    return f"""steps AS (
  SELECT 0 AS step, entity, 0.0::DOUBLE AS za, 0.0::DOUBLE AS zb, 0.0::DOUBLE AS lik, {start} FROM (SELECT DISTINCT entity FROM design)
  UNION ALL
  SELECT step + 1, entity, za + e0 - ({pull[0]}), zb + e1 - ({pull[1]}), lik, {', '.join([*(f'b_{i} + u_{i}, v_{i}' for i in range(n)), *(f'w_{i}_{j}' for i, j in cross)])}
  FROM ({_solved(columns, summed, keep, cross)})),
ended AS (SELECT * FROM steps WHERE step = {STEPS})"""


# cells of the latest two seasons with both scores, numbered groups
RECENT_DESIGN = RECENT_ENTITY + """,
known AS (
  SELECT r.entity, group_name, CAST(dense_rank() OVER (ORDER BY group_name) AS INTEGER) - 1 AS place, metric_mean_z AS m, (metric - s.m) / sd AS x, outcome
  FROM recent r JOIN scaled s ON s.entity = r.entity WHERE outcome IS NOT NULL AND metric IS NOT NULL AND sd > 0 AND metric_mean_z IS NOT NULL),
design AS (SELECT entity, group_name, place, m, x, count(*) AS trials, sum(outcome) AS wins FROM known GROUP BY ALL)"""
MVP_COLUMNS = ["1.0", "x", "m"]
GROUP_COLUMNS = MVP_COLUMNS + [f"(place = {k})::DOUBLE" for k in range(1, 5)]  # the sample tables have five regions
GIVEN_MVP = f"{RECENT_DESIGN}, {_penalised(MVP_COLUMNS, GIVEN['mvp']['sd_slope'], GIVEN['mvp']['sd_intercept'])}"
GIVEN_SENSITIVITY = f"{RECENT_DESIGN}, {_penalised(GROUP_COLUMNS, GIVEN['sensitivity']['sd_slope'])}"
TEAMS = "teams AS (SELECT DISTINCT entity, group_name FROM recent)"


def _given_table(with_cte, groups):
    """Coefficients, the spreads' log-likelihood and sizes of the fit, as one long table."""
    ends = "(SELECT * FROM ended LIMIT 1)"
    terms = [f"SELECT '{name}' AS term, b_{i} AS estimate, sqrt(v_{i}) AS std_error FROM {ends}" for i, name in enumerate(("(Intercept)", "metric_c_z", "metric_mean_z"))]
    terms += [f"SELECT 'group_name' || group_name, b_{k + 2}, sqrt(v_{k + 2}) FROM {ends}, (SELECT DISTINCT group_name FROM design WHERE place = {k})" for k in range(1, groups)]
    return f"""WITH RECURSIVE {with_cte}, fitted AS ({' UNION ALL '.join(terms)})
        SELECT 'fixed' AS part, term, {COLUMNS} FROM fitted
        UNION ALL SELECT 'fit', 'log_lik', round(lik, 6) + 0.0, NULL, NULL, NULL FROM {ends}
        UNION ALL SELECT 'fit', 'n_obs', (SELECT sum(trials) FROM design)::DOUBLE, NULL, NULL, NULL
        UNION ALL SELECT 'fit', 'n_entities', (SELECT count(*) FROM ended)::DOUBLE, NULL, NULL, NULL"""


SQL = {
    "given_mvp": _given_table(GIVEN_MVP, 1),
    "given_sensitivity": _given_table(GIVEN_SENSITIVITY, 5),
    "given_top3": f"""WITH RECURSIVE {GIVEN_SENSITIVITY}, {TEAMS},
        ranks AS (SELECT group_name, entity, zb AS slope, b_1 + zb AS total_slope,
                         rank() OVER (PARTITION BY group_name ORDER BY b_1 + zb DESC) AS place FROM ended JOIN teams USING (entity))
        SELECT group_name, entity, {_round('slope')}, {_round('total_slope')} FROM ranks WHERE place <= 3""",
    "given_summary": f"""WITH RECURSIVE {GIVEN_MVP},
        residuals AS (
          SELECT CASE WHEN outcome = 1 THEN sqrt((1 - p) / p) ELSE -sqrt(p / (1 - p)) END AS residual
          FROM (SELECT outcome, 1 / (1 + exp(-(b_0 + za + b_2 * m + (b_1 + zb) * x))) AS p FROM known JOIN ended USING (entity)))
        SELECT 'residual' AS part, 'min' AS term, NULL AS other, {_round('value', 'min(residual)')} FROM residuals
        UNION ALL SELECT 'residual', 'q1', NULL, {_round('value', 'quantile_cont(residual, 0.25)')} FROM residuals
        UNION ALL SELECT 'residual', 'median', NULL, {_round('value', 'quantile_cont(residual, 0.5)')} FROM residuals
        UNION ALL SELECT 'residual', 'q3', NULL, {_round('value', 'quantile_cont(residual, 0.75)')} FROM residuals
        UNION ALL SELECT 'residual', 'max', NULL, {_round('value', 'max(residual)')} FROM residuals
        UNION ALL SELECT 'correlation', 'metric_c_z', '(Intercept)', round(w_0_1 / sqrt(v_0 * v_1), 6) + 0.0 FROM (SELECT * FROM ended LIMIT 1)
        UNION ALL SELECT 'correlation', 'metric_mean_z', '(Intercept)', round(w_0_2 / sqrt(v_0 * v_2), 6) + 0.0 FROM (SELECT * FROM ended LIMIT 1)
        UNION ALL SELECT 'correlation', 'metric_mean_z', 'metric_c_z', round(w_1_2 / sqrt(v_1 * v_2), 6) + 0.0 FROM (SELECT * FROM ended LIMIT 1)""",
    "given_relative": f"""WITH RECURSIVE {GIVEN_MVP}, {TEAMS},
        totals AS (SELECT group_name, entity, b_0 + za AS total_intercept, b_1 + zb AS total_slope FROM ended JOIN teams USING (entity)),
        centred AS (SELECT *, total_intercept - avg(total_intercept) OVER (PARTITION BY group_name) AS intercept_std FROM totals)
        SELECT group_name, c.entity, {_round('total_intercept')}, {_round('total_slope')}, {_round('intercept_std')},
               {_round('total_effect', 'total_slope + intercept_std')}, n_games FROM centred c JOIN scaled s ON s.entity = c.entity""",
    "probit_interaction": f"WITH RECURSIVE {LINES}{CONTRASTS} SELECT group_name, entity, reference_entity, separated, term_kind, term, {COLUMNS} FROM terms",
    "probit_reference": f"""WITH RECURSIVE {LINES}{CONTRASTS.replace('min(entity) FILTER (slope IS NOT NULL)', CHOSEN_FIRST)}
        SELECT group_name, entity, reference_entity, separated, term_kind, term, {COLUMNS} FROM terms""",
    "probit_top": f"""WITH RECURSIVE {LINES}{CONTRASTS},
        placed_terms AS (SELECT *, rank() OVER (PARTITION BY group_name ORDER BY estimate DESC NULLS LAST) AS place FROM terms WHERE term_kind = 'interaction')
        SELECT group_name, entity, reference_entity, separated, term_kind, term, {COLUMNS} FROM placed_terms WHERE place = 1""",
    "probit_global_top": f"""WITH RECURSIVE {LINES}{GLOBAL},
        placed_terms AS (SELECT *, rank() OVER (PARTITION BY group_name ORDER BY estimate DESC NULLS LAST) AS place FROM terms)
        SELECT entity, group_name, term_kind, term, reference_entity, {COLUMNS} FROM placed_terms WHERE place = 1""",
    "probit_global": f"""WITH RECURSIVE {SHARED} SELECT term_kind, term, entity, (SELECT reference_entity FROM ref) AS reference_entity, {COLUMNS} FROM terms""",
    "glm_controls": f"""WITH RECURSIVE {FRAME},
        numbered AS (SELECT metric, final, outcome, row_number() OVER (PARTITION BY entity ORDER BY date, game, group_name, metric) AS appearance FROM frame),
        design AS (SELECT metric, final, appearance, count(*) AS trials, sum(outcome) AS wins FROM numbered WHERE outcome IS NOT NULL AND metric IS NOT NULL GROUP BY ALL),
        {_logit(['metric', 'final', 'appearance'], [10.0, 1.0, 100.0])}
        SELECT term, {COLUMNS} FROM fitted""",
}
