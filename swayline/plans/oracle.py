"""The same results as plain SQL text, for a second engine to check against."""

from swayline.plans.descriptive import CHOSEN, DRIFT, FIRST_SEASON, LACKING, TRIAL
from swayline.plans.inputs import MIN_RECENT, MIN_ROWS, START_DATE

GROUPS = """
groups AS (
  SELECT s_suppkey, s_name AS entity, r_name AS group_name
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

CONTESTS = GROUPS + """,
obs AS (
  SELECT l_orderkey AS game, entity, group_name, l_linestatus AS status, l_quantity AS metric, p_type AS role_code
  FROM lineitem LEFT JOIN groups ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey),
sides AS (SELECT game, group_name, sum(metric) AS points FROM obs GROUP BY game, group_name),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY game ORDER BY points DESC, group_name DESC) AS place FROM sides),
pairs AS (
  SELECT a.game, a.group_name AS team1, a.points AS points1, b.group_name AS team2, coalesce(b.points, 0.0) AS points2
  FROM (SELECT * FROM placed WHERE place = 1) a LEFT JOIN (SELECT * FROM placed WHERE place = 2) b ON a.game = b.game),
contests AS (
  SELECT o_orderkey AS game, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(month(o_orderdate) AS VARCHAR) AS round_number,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Finals' ELSE 'Regular' END AS round_type,
         CASE WHEN o_orderkey % 2 = 1 THEN team2 ELSE team1 END AS home_team,
         CASE WHEN o_orderkey % 2 = 1 THEN team1 ELSE team2 END AS away_team,
         CASE WHEN o_orderkey % 2 = 1 THEN points2 ELSE points1 END AS home_points,
         CASE WHEN o_orderkey % 2 = 1 THEN points1 ELSE points2 END AS away_points
  FROM orders LEFT JOIN pairs ON o_orderkey = game),
won AS (
  SELECT *, CASE WHEN home_points > away_points THEN home_team WHEN home_points < away_points THEN away_team
                 WHEN home_points = away_points THEN 'Draw' END AS winner
  FROM contests)"""

OBSERVED = CONTESTS + """,
observed AS (
  SELECT date, season, obs.game, round_number, round_type, winner, entity, group_name, metric, role_code, status
  FROM obs LEFT JOIN won ON obs.game = won.game WHERE metric IS NOT NULL)"""

FRAME = OBSERVED + f""",
frame AS (
  SELECT *, CASE WHEN group_name = winner THEN 1.0 WHEN group_name <> winner THEN 0.0 END::DOUBLE AS outcome,
         coalesce(CAST(round_type = 'Finals' AS INTEGER), 0) AS final
  FROM observed WHERE date > DATE '{START_DATE}')"""

ELIGIBLE = FRAME + f""",
rows AS (
  SELECT date, game, season, entity, group_name, metric, outcome FROM
    (SELECT *, count(*) OVER (PARTITION BY entity, group_name) AS n_pair FROM frame) WHERE n_pair >= {MIN_ROWS})"""

def _renamed(column, lacking=""):
    pairs = {"AMERICA": "AMERICAS", "ASIA": "ASIA PACIFIC", "MIDDLE EAST": "GULF"}
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items() if a != lacking)
    return f"CASE {column} {cases} ELSE {column} END"


NATIVE = CONTESTS + """,
first_games AS (SELECT date, season, home_team, away_team, min(game) AS game FROM contests GROUP BY ALL),
daily AS (
  SELECT w.date, w.season, w.game, round_type, winner, {home} AS home_team, {away} AS away_team, {won} AS named_winner
  FROM won w JOIN first_games f ON f.game = w.game),
native AS (
  SELECT won.date, won.season, won.round_number, replace(entity, '#', ' ') AS entity, group_name, metric, role_code,
         {full_home} AS home_team, {full_away} AS away_team
  FROM obs JOIN won ON obs.game = won.game)"""


def _native(lacking=""):
    return NATIVE.format(home=_renamed("w.home_team", lacking), away=_renamed("w.away_team", lacking), won=_renamed("winner", lacking),
                         full_home=_renamed("home_team"), full_away=_renamed("away_team"))


NAMED = """
typed AS (
  SELECT CASE WHEN p_size % 2 = 1 THEN upper(p_name || '-' || p_brand) ELSE p_name || '-' || p_brand END AS raw_name,
         l_quantity AS metric
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
titled AS (
  SELECT raw_name, metric, array_to_string(list_transform(string_split(lower(raw_name), ' '),
      lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: upper(v[1:1]) || v[2:]), '-')), ' ') AS t
  FROM typed),
named AS (
  SELECT raw_name, metric, CASE t WHEN 'Blue Bolt-Brand#1' THEN 'Blue Bolt-Brand#10'
                        WHEN 'Red Gear-Brand#2' THEN 'Red Gear-Brand#20' ELSE t END AS entity
  FROM titled),
summary AS (
  SELECT entity, avg(metric) AS mean_metric, median(metric) AS median_metric, max(metric) AS max_metric,
         min(metric) AS min_metric, count(*) AS n_contests
  FROM named GROUP BY entity)"""

CLEANED = GROUPS + """,
cleaned AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(month(o_orderdate) AS INTEGER) AS round_number,
         split_part(entity, '#', 1) AS first_name, split_part(entity, '#', 2) AS surname,
         group_name AS team_name, p_type AS player_position, l_linestatus = 'F' AS captain,
         p_size AS games_played, CASE WHEN o_orderstatus <> 'P' THEN l_quantity END AS rating_points,
         group_name AS home_team, l_linestatus AS away_team
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN groups ON l_suppkey = s_suppkey
       LEFT JOIN part ON l_partkey = p_partkey)"""

RECENT_ENTITY = ELIGIBLE + f""",
recent AS (SELECT * FROM rows WHERE season >= (SELECT max(season) FROM rows) - 1),
means AS (
  SELECT entity, count(metric) AS n_games, avg(metric) AS m, stddev_samp(metric) AS sd
  FROM recent GROUP BY entity HAVING count(metric) >= {MIN_RECENT}),
scaled AS (
  SELECT *, (m - (SELECT avg(m) FROM means)) / (SELECT stddev_samp(m) FROM means) AS metric_mean_z FROM means)"""

FITS = FRAME + """,
fits AS (
  SELECT {group} AS group_name, entity, regr_count(outcome, metric) AS n, regr_avgx(outcome, metric) AS avgx,
         regr_sxx(outcome, metric) AS sxx, regr_slope(outcome, metric) AS slope,
         regr_intercept(outcome, metric) AS intercept,
         regr_syy(outcome, metric) - regr_sxy(outcome, metric) * regr_sxy(outcome, metric) / regr_sxx(outcome, metric) AS rss,
         sum(outcome) FILTER (metric IS NOT NULL) AS total, sum(outcome * outcome) FILTER (metric IS NOT NULL) AS squares
  FROM frame {where} GROUP BY {group}, entity HAVING count(*) >= {min_rows} AND regr_sxx(outcome, metric) > 0)"""

TERMS = FITS + """,
first AS (SELECT group_name, {reference} AS reference_entity, sum(rss) AS rss, CAST(sum(n) - 2 * count(*) AS BIGINT) AS df_residual,
                 2 * count(*) - 1 AS df_model, 1 - sum(rss) / (sum(squares) - sum(total) * sum(total) / sum(n)) AS r_squared
          FROM fits GROUP BY group_name),
ref AS (SELECT first.*, first.rss / df_residual AS s2, slope AS r_slope, intercept AS r_intercept,
               1.0 / sxx AS r_inv, 1.0 / n + avgx * avgx / sxx AS r_level
        FROM first JOIN fits ON first.group_name = fits.group_name AND reference_entity = entity),
both_sides AS (SELECT fits.*, ref.* EXCLUDE (group_name, rss), 1.0 / sxx AS inv, 1.0 / n + avgx * avgx / sxx AS level
               FROM fits JOIN ref ON fits.group_name = ref.group_name),
terms AS (
  SELECT group_name, entity, reference_entity, df_residual, 'intercept' AS term_kind, '(Intercept)' AS term,
         r_intercept AS estimate, sqrt(s2 * r_level) AS std_error FROM both_sides WHERE entity = reference_entity
  UNION ALL
  SELECT group_name, entity, reference_entity, df_residual, 'metric', 'metric', r_slope, sqrt(s2 * r_inv)
  FROM both_sides WHERE entity = reference_entity
  UNION ALL
  SELECT group_name, entity, reference_entity, df_residual, 'entity', 'entity' || entity, intercept - r_intercept,
         sqrt(s2 * (level + r_level)) FROM both_sides WHERE entity <> reference_entity
  UNION ALL
  SELECT group_name, entity, reference_entity, df_residual, 'interaction', 'metric:entity' || entity, slope - r_slope,
         sqrt(s2 * (inv + r_inv)) FROM both_sides WHERE entity <> reference_entity),
tested AS (
  SELECT terms.*, r_squared, 1 - (1 - r_squared) * (df_model + terms.df_residual) / terms.df_residual AS adj_r_squared,
         r_squared / df_model / ((1 - r_squared) / terms.df_residual) AS f_statistic, df_model
  FROM terms JOIN first ON first.group_name = terms.group_name)"""


def _f_tail(f, above, below):
    """P(F > f) by Simpson's rule on the density at the square of the variable, which is smooth at zero.

    Beyond ten times the variable's unit nothing is left at the degrees of freedom that occur here.
    """
    top, steps = f"least(sqrt({f}), 10.0)", 1000
    log_density = (f"lgamma(({above} + {below}) / 2.0) - lgamma({above} / 2.0) - lgamma({below} / 2.0) + {above} / 2.0 * ln({above} / {below}::DOUBLE) "
                   f"+ ({above} - 1) * ln(u) - ({above} + {below}) / 2.0 * ln(1 + {above} * u * u / {below})")
    at_zero = f"CASE WHEN {above} = 1 THEN 2 * exp(lgamma((1 + {below}) / 2.0) - lgamma(0.5) - lgamma({below} / 2.0) - 0.5 * ln({below}::DOUBLE)) ELSE 0 END"
    inner = log_density.replace("(u)", f"({top} * i / {steps})").replace("u * u", f"power({top} * i / {steps}, 2)")
    return (f"greatest(0.0, 1 - {top} / {3 * steps} * ({at_zero} + list_sum(list_transform(range(1, {steps + 1}), "
            f"lambda i: (CASE WHEN i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2 * exp({inner})))))")


LISTED = ", ".join(f"'{c}'" for c in CHOSEN)
CHOSEN_FIRST = f"coalesce(arg_min(entity, list_position([{LISTED}], entity)) FILTER (entity IN ({LISTED}) AND slope IS NOT NULL), min(entity) FILTER (slope IS NOT NULL))"
BY_GROUP = dict(group="group_name", where="", min_rows=MIN_ROWS, reference="min(entity)")
TRIAL_ONLY = dict(
    reference="min(entity)",
    group="'all'", min_rows=1, where="WHERE entity IN (" + ", ".join(f"'{name}'" for name in TRIAL) + ")"
)
TERM_COLUMNS = (
    "group_name, entity, reference_entity, df_residual, term_kind, term, round(estimate, 6) + 0.0 AS estimate, "
    "round(std_error, 6) + 0.0 AS std_error, round(estimate / std_error, 6) + 0.0 AS statistic, "
    "round(r_squared, 6) + 0.0 AS r_squared, round(adj_r_squared, 6) + 0.0 AS adj_r_squared, round(f_statistic, 6) + 0.0 AS f_statistic, "
    f"round({_f_tail('f_statistic', 'df_model', 'df_residual')}, 6) + 0.0 AS f_p_value, "
    f"round({_f_tail('(estimate * estimate / std_error / std_error)', '1', 'df_residual')}, 6) + 0.0 AS p_value"
)

DENSITY = """,
shape AS (
  SELECT {key} AS k, count(v) AS n, min(v) AS lo, (max(v) - min(v)) / ({points} - 1) AS step,
         CASE WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25)
              THEN least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34)
              ELSE stddev_samp(v) END * 0.9 * pow(count(v), -0.2) AS bandwidth
  FROM src GROUP BY {key}),
usable AS (SELECT * FROM shape WHERE step > 0 AND bandwidth > 0),
placed_values AS (
  SELECT usable.*, (v - lo) / step AS place, least(floor((v - lo) / step), {points} - 2) AS bin
  FROM src JOIN usable ON {key} = k),
bins AS (
  SELECT k, n, lo, step, bandwidth, bin, sum(1 - (place - bin)) AS left_mass, sum(place - bin) AS right_mass
  FROM placed_values GROUP BY k, n, lo, step, bandwidth, bin),
curve AS (
  SELECT k, CAST(point AS INTEGER) AS point, lo + point * step AS x,
         sum(left_mass * exp(-0.5 * pow((point - bin) * step / bandwidth, 2))
             + right_mass * exp(-0.5 * pow((point - bin - 1) * step / bandwidth, 2)))
           / (n * bandwidth * sqrt(2 * pi())) AS density
  FROM bins, range(0, {points}) AS grid(point) GROUP BY k, n, lo, step, bandwidth, point
  UNION ALL SELECT k, 0, lo, NULL FROM shape WHERE NOT coalesce(step > 0 AND bandwidth > 0, false))"""


def _r(name, expression=None):
    return f"round({expression or name}, 6) + 0.0 AS {name}"


LINES = FITS.format(**BY_GROUP) + """,
lines AS (SELECT group_name, entity, slope AS total_slope, intercept AS total_intercept, slope + intercept AS total_effect FROM fits),
placed_lines AS (
  SELECT *, rank() OVER (PARTITION BY group_name ORDER BY total_slope DESC) AS slope_rank,
         row_number() OVER (PARTITION BY group_name ORDER BY total_slope DESC, entity) AS slope_place,
         row_number() OVER (PARTITION BY group_name ORDER BY total_effect DESC, entity) AS effect_place FROM lines),
relative AS (
  SELECT group_name, entity, total_slope, total_intercept, mean_level AS group_mean_intercept,
         total_intercept - mean_level AS intercept_std, total_slope + total_intercept - mean_level AS total_effect
  FROM lines JOIN (SELECT group_name, avg(total_intercept) AS mean_level FROM lines GROUP BY group_name) USING (group_name))"""
LINE_COLUMNS = f"group_name, entity, {_r('total_slope')}, {_r('total_intercept')}, {_r('total_effect')}"


SQL = {
    "line_ranking": f"WITH {LINES} SELECT {LINE_COLUMNS} FROM lines ORDER BY lines.total_slope DESC, entity LIMIT 10",
    "line_top3_slopes": f"WITH {LINES} SELECT {LINE_COLUMNS} FROM placed_lines WHERE slope_rank <= 3",
    "line_top3_effects": f"WITH {LINES} SELECT {LINE_COLUMNS} FROM placed_lines WHERE effect_place <= 3",
    "line_group_relative": f"""WITH {LINES} SELECT {LINE_COLUMNS}, {_r('group_mean_intercept')}, {_r('intercept_std')}
        FROM relative""",
    "line_group_table": f"""WITH {LINES} SELECT entity, group_name, {_r('intercept_std')}, {_r('total_slope')},
        {_r('total_effect')} FROM relative WHERE group_name = 'ASIA'""",
    "line_group_head": f"""WITH {LINES} SELECT entity, {_r('total_slope')}, {_r('total_effect')} FROM relative
        WHERE group_name = 'MIDDLE EAST' ORDER BY relative.total_effect DESC, entity LIMIT 10""",
    "line_top3_subset": f"""WITH {LINES} SELECT group_name, entity, {_r('total_slope')} FROM lines
        WHERE entity IN (SELECT entity FROM placed_lines WHERE slope_place <= 3)""",
    "line_predict_grid": f"""WITH {LINES} SELECT entity, group_name, x::DOUBLE AS x,
        round(1 / (1 + exp(-(total_intercept + total_slope * x))), 6) + 0.0 AS probability
        FROM lines, (VALUES (0.0), (10.0), (25.0), (40.0), (50.0)) AS grid(x) WHERE group_name = 'ASIA'""",
    "appearance_join": f"""WITH {FRAME}, counters AS (SELECT date, entity, CAST(row_number() OVER
        (PARTITION BY entity ORDER BY date, game, group_name, metric) AS INTEGER) AS appearance FROM frame)
        SELECT f.date, f.game, f.entity, f.group_name, f.metric, c.appearance
        FROM frame f LEFT JOIN counters c ON f.date = c.date AND f.entity = c.entity""",
    "contest_winner": f"WITH {CONTESTS} SELECT * FROM won",
    "season_store": f"""WITH {CONTESTS}
        SELECT game, date, season, CASE WHEN season <> {DRIFT + 2} THEN round_number END AS round_number,
               CASE WHEN season >= {DRIFT} OR season = {FIRST_SEASON + 1} THEN round_type END AS round_type, home_team, away_team, home_points, away_points,
               CASE WHEN season >= {DRIFT} THEN winner END AS winner
        FROM won WHERE season BETWEEN {FIRST_SEASON} AND {DRIFT + 2}""",
    "native_join": f"""WITH {_native()}
        SELECT n.date, n.season, d.game, n.round_number, d.round_type, d.named_winner AS winner, n.entity, n.group_name, n.metric, n.role_code
        FROM native n LEFT JOIN daily d ON n.date = d.date AND n.season = d.season AND n.home_team = d.home_team AND n.away_team = d.away_team
        WHERE n.metric IS NOT NULL""",
    "native_join_audit": f"""WITH {_native(LACKING)}
        SELECT 'observations' AS side, home_team, away_team, count(*) AS n FROM native n ANTI JOIN daily d
          ON n.date = d.date AND n.season = d.season AND n.home_team = d.home_team AND n.away_team = d.away_team GROUP BY ALL
        UNION ALL SELECT 'contests', home_team, away_team, count(*) FROM daily d ANTI JOIN native n
          ON n.date = d.date AND n.season = d.season AND n.home_team = d.home_team AND n.away_team = d.away_team GROUP BY ALL""",
    "clean_observations": f"WITH {CLEANED} SELECT * FROM cleaned WHERE rating_points IS NOT NULL",
    "recode_groups": f"""WITH {CONTESTS},
        names(contest_name, observation_name) AS (VALUES ('AMERICA', 'AMERICAS'), ('ASIA', 'ASIA PACIFIC'),
          ('MIDDLE EAST', 'GULF'), ('AFRICA', 'AFRICA'), ('EUROPE', 'EUROPE'))
        SELECT game, coalesce(h.observation_name, home_team) AS home_team,
               coalesce(a.observation_name, away_team) AS away_team,
               coalesce(w.observation_name, winner) AS winner, w.observation_name
        FROM won LEFT JOIN names h ON home_team = h.contest_name LEFT JOIN names a ON away_team = a.contest_name
             LEFT JOIN names w ON winner = w.contest_name""",
    "group_names": f"WITH {CONTESTS} SELECT DISTINCT away_team FROM contests ORDER BY away_team NULLS LAST",
    "join_contests": f"""WITH {OBSERVED} SELECT date, season, game, round_type, winner, entity, group_name, metric
        FROM observed""",
    "entity_summary": f"""WITH {NAMED} SELECT entity, {_r('mean_metric')}, {_r('median_metric')}, {_r('max_metric')},
        {_r('min_metric')}, n_contests FROM summary ORDER BY summary.mean_metric DESC, entity""",
    "name_audit": f"""WITH {NAMED} SELECT entity, {_r('mean_metric')}, {_r('median_metric')}, {_r('max_metric')},
        {_r('min_metric')}, n_contests FROM summary
        WHERE length(entity) - length(replace(entity, ' ', '')) = 2 OR contains(entity, '-') ORDER BY entity""",
    "name_collisions": f"""WITH {NAMED} SELECT entity, count(DISTINCT raw_name) AS n_spellings,
        min(raw_name) AS first_spelling, max(raw_name) AS last_spelling
        FROM named GROUP BY entity HAVING count(DISTINCT raw_name) > 1""",
    "null_audit": f"""WITH {CLEANED} SELECT 'season' AS column_name, count(*) - count(season) AS n_missing FROM cleaned
        UNION ALL SELECT 'round_number', count(*) - count(round_number) FROM cleaned
        UNION ALL SELECT 'games_played', count(*) - count(games_played) FROM cleaned
        UNION ALL SELECT 'rating_points', count(*) - count(rating_points) FROM cleaned""",
    "appearance_number": f"""WITH {FRAME} SELECT date, game, entity, group_name, metric, CAST(row_number() OVER
        (PARTITION BY entity ORDER BY date, game, group_name, metric) AS INTEGER) AS appearance FROM frame""",
    "primary_role": f"""WITH {FRAME}, counted AS (
        SELECT entity, CASE role_code WHEN 'ECONOMY' THEN 'forward' WHEN 'SMALL' THEN 'midfielder'
               WHEN 'MEDIUM' THEN 'defender' WHEN 'LARGE' THEN 'ruck' WHEN 'PROMO' THEN 'sub' END AS role,
               count(*) AS role_count FROM frame GROUP BY 1, 2)
        SELECT entity, role, role_count FROM (SELECT *, row_number() OVER
          (PARTITION BY entity ORDER BY role_count DESC, role NULLS LAST) AS place FROM counted) WHERE place = 1""",
    "model_frame": f"""WITH {FRAME}, counted AS (
        SELECT entity, CASE role_code WHEN 'ECONOMY' THEN 'forward' WHEN 'SMALL' THEN 'midfielder'
               WHEN 'MEDIUM' THEN 'defender' WHEN 'LARGE' THEN 'ruck' WHEN 'PROMO' THEN 'sub' END AS role,
               count(*) AS role_count FROM frame GROUP BY 1, 2),
        main AS (SELECT entity, role FROM (SELECT *, row_number() OVER
          (PARTITION BY entity ORDER BY role_count DESC, role NULLS LAST) AS place FROM counted) WHERE place = 1),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, game, group_name, metric) AS a,
          count(*) OVER (PARTITION BY entity, group_name) AS n_pair,
          avg(metric) OVER (PARTITION BY entity, group_name) AS m,
          stddev_samp(metric) OVER (PARTITION BY entity, group_name) AS sd FROM frame)
        SELECT date, game, season, round_number, numbered.entity, metric, group_name, outcome, final,
          CAST(a AS INTEGER) AS appearance,
          CAST(coalesce(role = 'forward', false) AS INTEGER) AS role_forward,
          CAST(coalesce(role = 'midfielder', false) AS INTEGER) AS role_midfielder,
          CAST(coalesce(role = 'defender', false) AS INTEGER) AS role_defender,
          CAST(coalesce(role = 'ruck', false) AS INTEGER) AS role_ruck,
          CAST(coalesce(role = 'sub', false) AS INTEGER) AS role_sub,
          CAST(coalesce(role = 'bench', false) AS INTEGER) AS role_bench,
          CAST(role IS NULL AS INTEGER) AS no_role,
          {_r('std_metric', '(metric - m) / nullif(sd, 0)')}
        FROM numbered LEFT JOIN main ON numbered.entity = main.entity WHERE n_pair >= {MIN_ROWS}""",
    "centred_frame": f"""WITH {ELIGIBLE}, c AS (SELECT *, avg(metric) OVER (PARTITION BY entity) AS m FROM rows)
        SELECT date, game, season, entity, group_name, metric, outcome, {_r('metric_mean', 'm')},
               {_r('metric_centred', 'metric - m')} FROM c""",
    "entity_means_ranked": f"""WITH {ELIGIBLE}, e AS (SELECT entity, avg(metric) AS m FROM rows GROUP BY entity)
        SELECT entity, {_r('metric_mean', 'm')} FROM e ORDER BY m DESC, entity""",
    "entity_checks": f"""WITH {ELIGIBLE} SELECT entity, {_r('metric_mean', 'avg(metric)')}, count(*) AS n,
        {_r('sd_metric', 'stddev_samp(metric)')}, {_r('var_outcome', 'var_samp(outcome)')},
        coalesce(stddev_samp(metric) < 1e-8, true) AS no_spread,
        coalesce(var_samp(outcome) < 1e-8, true) AS no_outcome_variation FROM rows GROUP BY entity""",
    "recent_frame_rowz": f"""WITH {ELIGIBLE},
        c AS (SELECT *, avg(metric) OVER (PARTITION BY entity) AS m FROM rows),
        r AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n_games FROM c
              WHERE season >= (SELECT max(season) FROM c) - 1),
        k AS (SELECT *, metric - m AS mc FROM r WHERE n_games >= {MIN_RECENT}),
        g AS (SELECT avg(mc) AS a1, stddev_samp(mc) AS s1, avg(m) AS a2, stddev_samp(m) AS s2 FROM k)
        SELECT date, game, season, entity, group_name, metric, outcome, {_r('metric_mean', 'm')},
               {_r('metric_centred', 'mc')}, n_games, {_r('metric_centred_z', '(mc - a1) / s1')},
               {_r('metric_mean_z', '(m - a2) / s2')} FROM k, g""",
    "recent_frame_entityz": f"""WITH {RECENT_ENTITY}
        SELECT date, game, season, recent.entity, group_name, metric, outcome, n_games, {_r('metric_mean_z')},
               {_r('metric_c', 'metric - m')}, {_r('metric_c_z', '(metric - m) / nullif(sd, 0)')}
        FROM recent JOIN scaled ON recent.entity = scaled.entity""",
    "entity_groups": f"""WITH {OBSERVED},
        g AS (SELECT entity, status AS group_name, max(date) AS last_date FROM observed GROUP BY entity, status),
        cur AS (SELECT entity, status AS current_group FROM (SELECT entity, status, row_number() OVER
                (PARTITION BY entity ORDER BY date DESC, game DESC, status DESC) AS place FROM observed)
                WHERE place = 1)
        SELECT g.entity, group_name, last_date, current_group, group_name = current_group AS is_current
        FROM g JOIN cur ON g.entity = cur.entity""",
    "metric_by_outcome": f"""WITH {FRAME} SELECT entity, outcome, {_r('mean_metric', 'avg(metric)')}, count(*) AS n
        FROM frame GROUP BY entity, outcome""",
    "ols_summary": f"""WITH {NAMED}, s AS (
        SELECT regr_count(mean_metric, n_contests) AS n, regr_slope(mean_metric, n_contests) AS b,
               regr_intercept(mean_metric, n_contests) AS a, regr_avgx(mean_metric, n_contests) AS mx,
               regr_sxx(mean_metric, n_contests) AS sxx, regr_sxy(mean_metric, n_contests) AS sxy,
               regr_syy(mean_metric, n_contests) AS syy FROM summary),
        f AS (SELECT *, CAST(n - 2 AS BIGINT) AS df_residual, (syy - sxy * sxy / sxx) / (n - 2) AS s2,
                     sxy * sxy / (sxx * syy) AS r2 FROM s),
        t AS (SELECT '(Intercept)' AS term, a AS estimate, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS std_error, * FROM f
              UNION ALL SELECT 'n_contests', b, sqrt(s2 / sxx), * FROM f)
        SELECT term, {_r('estimate')}, {_r('std_error')}, CAST(n AS BIGINT) AS n, df_residual, {_r('sigma', 'sqrt(s2)')},
               {_r('r_squared', 'r2')}, round(t.estimate / t.std_error, 6) + 0.0 AS statistic,
               {_r('adj_r_squared', '1 - (1 - r2) * (n - 1) / (n - 2)')}, {_r('f_statistic', 'r2 / ((1 - r2) / (n - 2))')},
               {_r('f_p_value', _f_tail('(r2 / ((1 - r2) / (n - 2)))', '1', 'df_residual'))},
               {_r('p_value', _f_tail('(t.estimate * t.estimate / t.std_error / t.std_error)', '1', 'df_residual'))} FROM t""",
    "ols_trial": f"WITH {TERMS.format(**TRIAL_ONLY)} SELECT {TERM_COLUMNS} FROM tested",
    "ols_interaction": f"WITH {TERMS.format(**BY_GROUP)} SELECT {TERM_COLUMNS} FROM tested",
    "ols_reference": f"WITH {TERMS.format(**BY_GROUP | dict(reference=CHOSEN_FIRST))} SELECT {TERM_COLUMNS} FROM tested",
    "ols_top": f"""WITH {TERMS.format(**BY_GROUP)}, t AS (SELECT *, rank() OVER
        (PARTITION BY group_name ORDER BY estimate DESC) AS place FROM terms WHERE term_kind = 'interaction')
        SELECT group_name, entity, term, {_r('estimate')}, {_r('std_error')},
               round(t.estimate / t.std_error, 6) + 0.0 AS statistic FROM t WHERE place = 1""",
    "plot_scatter_labels": f"""WITH {NAMED} SELECT entity, n_contests, {_r('mean_metric')},
        CASE WHEN summary.mean_metric > 27 THEN entity ELSE '' END AS label_high,
        CASE WHEN summary.mean_metric < 25 AND n_contests > 60 THEN entity ELSE '' END AS label_low
        FROM summary WHERE n_contests >= 50""",
    "plot_mean_sd": f"""WITH {ELIGIBLE}, e AS (
        SELECT entity, avg(metric) AS m, stddev_samp(metric) AS s FROM rows GROUP BY entity)
        SELECT entity, {_r('metric_mean', 'm')}, {_r('sd_metric', 's')},
               CASE WHEN m > 25.5 AND s < 14.3 THEN entity END AS label_steady,
               CASE WHEN m > 26.2 THEN entity END AS label_top, CASE WHEN s > 14.7 THEN entity END AS label_volatile
        FROM e""",
    "plot_density": f"""WITH {OBSERVED}, src AS (SELECT 1 AS one, metric AS v FROM observed)
        {DENSITY.format(key='one', points=512)}
        SELECT point, {_r('x')}, {_r('density')} FROM curve""",
    "plot_mean_density": f"""WITH {NAMED}, src AS (SELECT 1 AS one, mean_metric AS v FROM summary)
        {DENSITY.format(key='one', points=512)}
        SELECT point, {_r('x')}, {_r('density')},
               round((SELECT avg(mean_metric) FROM summary), 6) + 0.0 AS overall_mean FROM curve""",
    "plot_group_density": f"""WITH {RECENT_ENTITY}, src AS (
        SELECT DISTINCT recent.entity, group_name AS g, metric_mean_z AS v
        FROM recent JOIN scaled ON recent.entity = scaled.entity)
        {DENSITY.format(key='g', points=512)}
        SELECT k AS group_name, point, {_r('x')}, {_r('density')} FROM curve""",
    "plot_top3_flags": f"""WITH {RECENT_ENTITY}, slopes AS (
        SELECT entity, regr_slope(outcome, metric) AS total_slope FROM rows GROUP BY entity),
        pts AS (SELECT DISTINCT recent.entity, group_name, metric_mean_z
                FROM recent JOIN scaled ON recent.entity = scaled.entity),
        j AS (SELECT pts.*, total_slope, row_number() OVER
              (PARTITION BY group_name ORDER BY total_slope DESC NULLS LAST, pts.entity) AS place
              FROM pts LEFT JOIN slopes ON pts.entity = slopes.entity)
        SELECT entity, group_name, {_r('metric_mean_z')}, {_r('total_slope')}, place <= 3 AS top3,
               CASE WHEN place <= 3 THEN group_name ELSE 'Other' END AS colour,
               CAST(dense_rank() OVER (ORDER BY group_name DESC) AS INTEGER) AS group_order FROM j""",
    "plot_slope_hist": f"""WITH {FITS.format(**BY_GROUP)},
        e AS (SELECT count(slope) AS n, min(slope) AS lo, max(slope) AS hi, ceil(log2(count(slope))) + 1 AS b FROM fits),
        c AS (SELECT least(floor((slope - lo) / ((hi - lo) / b)) + 1, b) AS bin, count(*) AS n FROM fits, e
              WHERE slope IS NOT NULL GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, {_r('bin_low', 'lo + (i - 1) * ((hi - lo) / b)')},
               {_r('bin_high', 'lo + i * ((hi - lo) / b)')}, coalesce(c.n, 0) AS n
        FROM e, range(1, 64) AS r(i) LEFT JOIN c ON c.bin = i WHERE i <= b""",
    "plot_slope_breaks": f"""WITH {FITS.format(**BY_GROUP)},
        e AS (SELECT min(slope) AS lo, max(slope) AS hi, (max(slope) - min(slope)) / (ceil(log2(count(slope))) + 1) AS w FROM fits),
        p AS (SELECT *, power(10.0, floor(log10(w))) AS p FROM e),
        u AS (SELECT *, p * CASE WHEN w <= 1.4 * p THEN 1 WHEN w <= 2.8 * p THEN 2 WHEN w <= 7 * p THEN 5 ELSE 10 END AS u FROM p),
        b AS (SELECT u, CAST(floor(lo / u + 1e-7) AS BIGINT) AS first, CAST(ceil(hi / u - 1e-7) AS BIGINT) AS last FROM u),
        edges AS (SELECT CAST(i AS INTEGER) AS bin, (first + i - 1) * u AS bin_low, (first + i) * u AS bin_high
                  FROM b, range(1, 64) AS r(i) WHERE i <= last - first)
        SELECT bin, {_r('bin_low')}, {_r('bin_high')}, count(slope) AS n
        FROM edges LEFT JOIN fits ON slope <= bin_high AND (slope > bin_low OR bin = 1) GROUP BY bin, edges.bin_low, edges.bin_high""",
}
