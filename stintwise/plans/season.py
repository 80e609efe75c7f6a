"""Qualifying, season and read-shape queries."""

from pyspark.sql import functions as F

from stintwise.constants import INDICATIVE, QUALI_LIKE, SESSION_KEYS, WEEKEND_KEYS
from stintwise.functions.text_rules import VERDICT_NONE, VERDICTS
from stintwise.operators import catalog as C
from stintwise.operators import pace as P
from stintwise.operators import quali as Q
from stintwise.operators import reads as R
from stintwise.operators import season as N
from stintwise.plans.columns import rounded, sql_text
from stintwise.plans.registry import ORACLES, query
from stintwise.plans.telemetry import GK, INDEX_SQL

UNITS = {"Alpha": ["NATION_0", "NATION_1"], "Beta": ["NATION_2"], "Gamma": ["NATION_3", "NATION_4"]}
UNIT_SQL = """CASE WHEN constructor IN ('NATION_0', 'NATION_1') THEN 'Alpha' WHEN constructor = 'NATION_2' THEN 'Beta'
 WHEN constructor IN ('NATION_3', 'NATION_4') THEN 'Gamma' END"""


@query(
    "best_across_sessions",
    """SELECT year, round, driver, sector, min(constructor) AS constructor, round(min(best_time_s), 6) AS best_time_s,
    arg_min(session_type, (best_time_s, list_position(['FP1','FP2','FP3','SQ','SPRINT','Q','R'], session_type))) AS session_type
    FROM sector_best GROUP BY ALL""",
)
def _(t):
    return rounded(Q.best_across_sessions(t.sector_bests))


@query(
    "sector_dominance",
    f"SELECT {GK}, sector, constructor, driver, round(best_time_s, 6) AS best_time_s, round(margin_s, 6) AS margin_s FROM dominance",
)
def _(t):
    return rounded(Q.sector_dominance(t.sector_bests, SESSION_KEYS))


@query(
    "sector_holder",
    f"SELECT {GK}, sector, constructor, driver, round(best_time_s, 6) AS best_time_s FROM team_sector",
)
def _(t):
    return rounded(
        t.sector_bests.groupBy(*SESSION_KEYS, "sector", "constructor").agg(
            F.min_by("driver", F.struct("best_time_s", "driver")).alias("driver"),
            F.min("best_time_s").alias("best_time_s"),
        )
    )


TOP_SQL = """SELECT year, round, driver, min(constructor) AS constructor, max(max_speed_kmh) AS max_speed_kmh,
 arg_min(session_type, (-max_speed_kmh, list_position(['FP1','FP2','FP3','SQ','SPRINT','Q','R'], session_type))) AS session_type FROM zone_speed GROUP BY ALL"""


@query(
    "best_top_speeds",
    f"""SELECT year, round, driver, constructor, round(max_speed_kmh, 6) AS max_speed_kmh, session_type,
    round(max_speed_kmh * CAST(0.621371 AS DOUBLE), 6) AS max_speed_mph FROM ({TOP_SQL})""",
)
def _(t):
    return rounded(Q.best_top_speeds(t.zones)).orderBy(F.desc("max_speed_kmh"))


REP = f"""{GK}, constructor, driver, lap_id, round(lap_time_s, 6) AS lap_time_s, round(top_speed_kmh, 6) AS top_speed_kmh,
 round(min_speed_kmh, 6) AS min_speed_kmh, round(full_throttle_share, 6) AS full_throttle_share"""
TOP5 = f"""SELECT *, CAST(row_number() OVER (PARTITION BY {GK} ORDER BY lap_time_s, constructor) AS INT) AS place FROM quali_rep QUALIFY place <= 5"""


@query("fastest_per_constructor", f"SELECT {REP} FROM quali_rep")
def _(t):
    return rounded(Q.fastest_per_constructor(t.quali_rows))


@query("top_teams", f"SELECT {REP}, place FROM ({TOP5})")
def _(t):
    return rounded(Q.top_teams(Q.fastest_per_constructor(t.quali_rows)))


CORNER_PICK = f"""picked AS (SELECT {GK}, arg_max(corner_number, (m, -corner_number)) AS corner_number, max(m) AS mean_kmh FROM (
  SELECT t.year, t.round, t.session_type, corner_number, avg(c.min_speed_kmh) AS m FROM top5 t JOIN corner_speed c ON c.lap_id = t.lap_id
  WHERE t.top_speed_kmh - c.min_speed_kmh >= 40 GROUP BY ALL) GROUP BY ALL)"""


@query(
    "fastest_corner",
    f"WITH top5 AS ({TOP5}), {CORNER_PICK} SELECT {GK}, corner_number, round(mean_kmh, 6) AS mean_kmh FROM picked",
)
def _(t):
    reps = Q.top_teams(Q.fastest_per_constructor(t.quali_rows))
    return rounded(Q.fastest_corner(reps, t.quali_corners))


CHARACTER = f"""WITH top5 AS ({TOP5}), {CORNER_PICK},
 r AS (SELECT t.*, c.min_speed_kmh AS fastest_corner_kmh FROM top5 t LEFT JOIN picked p USING ({GK})
       LEFT JOIN corner_speed c ON c.lap_id = t.lap_id AND c.corner_number = p.corner_number),
 k AS (SELECT *, ceil(count(*) OVER s / 2) AS half, row_number() OVER (s ORDER BY top_speed_kmh DESC NULLS LAST, constructor) AS sp,
   row_number() OVER (s ORDER BY full_throttle_share DESC NULLS LAST, constructor) AS th, row_number() OVER (s ORDER BY fastest_corner_kmh DESC NULLS LAST, constructor) AS co,
   row_number() OVER (s ORDER BY min_speed_kmh DESC NULLS LAST, constructor) AS gr FROM r WINDOW s AS (PARTITION BY {GK}))
SELECT {GK}, constructor, driver, place, round(lap_time_s, 6) AS lap_time_s, round(top_speed_kmh, 6) AS top_speed_kmh, round(min_speed_kmh, 6) AS min_speed_kmh,
  round(full_throttle_share, 6) AS full_throttle_share, round(fastest_corner_kmh, 6) AS fastest_corner_kmh,
  CASE WHEN sp <= half AND th <= half THEN 'efficient, low drag' WHEN sp > half AND co <= half THEN 'draggy, high-downforce'
       WHEN sp > half AND th > half THEN 'lacks efficiency' ELSE 'balanced' END AS drag_label,
  sp = 1 AS is_top_speed_leader, co = 1 AS is_corner_speed_leader, gr = 1 AS is_grip_leader FROM k"""


@query("car_character", CHARACTER.replace("(s ORDER", "(PARTITION BY year, round, session_type ORDER"))
def _(t):
    return rounded(Q.car_character(Q.fastest_per_constructor(t.quali_rows), t.quali_corners))


SECTOR_PAGE = ", ".join(
    f"round(max(best_time_s) FILTER (sector = {k}), 6) AS sector{k}_best_s, max(constructor) FILTER (sector = {k}) AS sector{k}_team, round(max(margin_s) FILTER (sector = {k}), 6) AS sector{k}_margin_s"
    for k in (1, 2, 3)
)


@query(
    "qualifying_tables",
    f"""SELECT * FROM ({CHARACTER.replace("(s ORDER", "(PARTITION BY year, round, session_type ORDER")})
    LEFT JOIN (SELECT {GK}, {SECTOR_PAGE} FROM dominance GROUP BY ALL) USING ({GK}) WHERE session_type IN ('Q', 'SQ')""",
)
def _(t):
    quali = t.quali_rows.where(F.col("session_type").isin(QUALI_LIKE))
    cars = Q.car_character(Q.fastest_per_constructor(quali), t.quali_corners)
    return rounded(Q.with_sector_leaders(cars, Q.sector_dominance(t.sector_bests, SESSION_KEYS)))


@query(
    "wear_page",
    f"""SELECT {GK}, constructor, driver, lap_number, compound, tyre_age, round(pace_s, 6) AS pace_s, round(slope_s_per_lap, 6) AS slope_s_per_lap,
      round(intercept_s, 6) AS intercept_s, round(cost_s, 6) AS cost_s, flagged
    FROM paced LEFT JOIN wear USING ({GK}, constructor, compound) WHERE session_type IN ('R', 'SPRINT') AND tyre_age IS NOT NULL""",
)
def _(t):
    """Wear as it is shown: every lap of a race by tyre age, beside its team's fit."""
    laps = t.paced.where(F.col("session_type").isin("R", "SPRINT"))
    return rounded(P.wear_page(laps, t.wear))


@query(
    "metric_mean_spread",
    """SELECT year, constructor, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, count(*) AS n FROM season_pace GROUP BY ALL""",
)
def _(t):
    pace = t.race_pace.select(*WEEKEND_KEYS, "constructor", F.col("gap_s").alias("value"))
    return rounded(N.metric_mean_spread(pace))


@query(
    "recency_mean_spread",
    "SELECT year, constructor, round(pace_mean, 6) AS mean, round(pace_spread, 6) AS spread, pace_n AS n FROM pace_agg",
)
def _(t):
    pace = t.race_pace.select(*WEEKEND_KEYS, "constructor", F.col("gap_s").alias("value"))
    current = t.sessions.groupBy("year").agg(F.max("round").alias("current_round"))
    return rounded(N.metric_mean_spread(pace, current))


@query(
    "minmax_normalize",
    """SELECT year, round, constructor, round(CASE WHEN h = l THEN 0 ELSE (value - l) / (h - l) END, 6) AS score FROM
    (SELECT *, min(value) OVER w AS l, max(value) OVER w AS h FROM season_pace WINDOW w AS (PARTITION BY year, round))""",
)
def _(t):
    rows = t.race_pace.select(
        *WEEKEND_KEYS, "constructor", N.normalized("gap_s", WEEKEND_KEYS).alias("score")
    )
    return rounded(rows)


@query(
    "overall_ranking",
    "SELECT year, constructor, round(score, 6) AS score, overall_rank FROM season_rank",
)
def _(t):
    snap = t.snapshot
    return rounded(
        N.overall_ranking(
            snap.select("year", "constructor", F.col("pace_mean").alias("pace")),
            snap.select("year", "constructor", F.col("quali_mean").alias("quali")),
            ["year"],
        )
    )


@query(
    "pace_quali_blend",
    "SELECT year, round, constructor, round(value, 6) AS value FROM blend",
)
def _(t):
    gaps, _ = N.quali_metrics(t.quali_rows, t.sessions)
    return rounded(
        N.season_trends(t.race_pace, gaps).where(F.col("metric") == "cumulative").drop("metric")
    )


SNAPSHOT = """SELECT year, constructor, overall_rank, round(pace_mean, 6) AS pace_mean, round(pace_spread, 6) AS pace_spread, pace_n,
 round(quali_mean, 6) AS quali_mean, round(quali_spread, 6) AS quali_spread, quali_n, round(top_speed_deficit_kmh, 6) AS top_speed_deficit_kmh,
 round(top_speed_deficit_mph, 6) AS top_speed_deficit_mph, sector_dominance_count, round(tyre_deg_s_per_lap, 6) AS tyre_deg_s_per_lap, confidence FROM snapshot"""


@query("season_snapshot", SNAPSHOT)
def _(t):
    return rounded(t.season_snapshot())


@query(
    "season_trends",
    "SELECT year, round, constructor, metric, round(value, 6) AS value FROM trends",
)
def _(t):
    gaps, _ = N.quali_metrics(t.quali_rows, t.sessions)
    return rounded(N.season_trends(t.race_pace, gaps))


@query(
    "trend_gap_fill",
    """WITH spine AS (SELECT t.year, constructor, metric, r.round FROM (SELECT DISTINCT year, constructor, metric FROM trends) t
       JOIN (SELECT DISTINCT year, round FROM lap_base) r ON t.year = r.year),
    f AS (SELECT s.*, t.value, last_value(CASE WHEN t.value IS NOT NULL THEN s.round END IGNORE NULLS) OVER b AS r0, last_value(t.value IGNORE NULLS) OVER b AS v0,
       first_value(CASE WHEN t.value IS NOT NULL THEN s.round END IGNORE NULLS) OVER a AS r1, first_value(t.value IGNORE NULLS) OVER a AS v1
     FROM spine s LEFT JOIN trends t USING (year, constructor, metric, round)
     WINDOW b AS (PARTITION BY s.year, s.constructor, s.metric ORDER BY s.round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       a AS (PARTITION BY s.year, s.constructor, s.metric ORDER BY s.round ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT year, constructor, metric, round, round(coalesce(value, v0 + (v1 - v0) * (round - r0) / (r1 - r0), v0, v1, 0), 6) AS value, value IS NOT NULL AS measured FROM f""",
)
def _(t):
    return rounded(N.trend_gap_fill(t.trends, t.sessions))


@query(
    "trend_legend_order",
    """SELECT year, constructor, metric, round(v, 6) AS sort_value, CAST(row_number() OVER (PARTITION BY year, metric ORDER BY v NULLS LAST, constructor) AS INT) AS legend_rank
    FROM (SELECT t.year, t.constructor, metric, CASE metric WHEN 'pace' THEN any_value(pace_mean) WHEN 'quali' THEN any_value(quali_mean) ELSE arg_max(value, round) END AS v
          FROM trends t LEFT JOIN snapshot s USING (year, constructor) GROUP BY t.year, t.constructor, metric)""",
)
def _(t):
    return rounded(N.trend_legend_order(t.trends, t.snapshot))


@query(
    "wear_legend",
    f"""SELECT a.year, a.round, a.session_type, a.constructor, b.compound, round(w.slope_s_per_lap, 6) AS slope_s_per_lap,
      CAST(row_number() OVER (PARTITION BY a.year, a.round, a.session_type, b.compound ORDER BY w.slope_s_per_lap DESC NULLS LAST, a.constructor) AS INT) AS legend_rank
    FROM (SELECT DISTINCT {GK}, constructor FROM wear) a JOIN (SELECT DISTINCT {GK}, compound FROM wear) b
      ON a.year = b.year AND a.round = b.round AND a.session_type = b.session_type
    LEFT JOIN wear w ON w.year = a.year AND w.round = a.round AND w.session_type = a.session_type AND w.constructor = a.constructor AND w.compound = b.compound""",
)
def _(t):
    return rounded(N.wear_legend(t.wear).drop("label"))


@query(
    "season_totals",
    """SELECT year, CAST(sum(n) AS BIGINT) AS total_laps, round_even(sum(n * CASE location WHEN 'Monza' THEN 5.793 WHEN 'Barcelona' THEN 4.657 WHEN 'Imola' THEN 4.909 ELSE 0 END::DOUBLE), 1) AS total_km
    FROM (SELECT year, round, count(*) AS n FROM paced GROUP BY ALL) JOIN calendar USING (year, round) GROUP BY year""",
)
def _(t):
    return N.season_totals(t.paced, t.calendar)


BINS = f"""bins AS (SELECT year, unit, floor(speed_kmh / 10) * 10 + 5 AS mid, quantile_cont(accel_ms2, 0.5) AS m, count(*) AS n
  FROM (SELECT *, {UNIT_SQL} AS unit FROM accel_pts) WHERE unit IS NOT NULL GROUP BY ALL),
 met AS (SELECT year, unit, CAST(sum(n) AS BIGINT) AS n_points,
   CASE WHEN count(*) FILTER (WHERE n >= 5 AND mid >= 250 AND mid < 290) >= 2 THEN quantile_cont(m, 0.5) FILTER (WHERE n >= 5 AND mid >= 250 AND mid < 290) END AS punch,
   CASE WHEN count(*) FILTER (WHERE n >= 5 AND mid >= 290) >= 2 THEN quantile_cont(m, 0.5) FILTER (WHERE n >= 5 AND mid >= 290) END AS hold FROM bins GROUP BY ALL)"""


@query(
    "pool_by_group",
    f"""WITH {BINS} SELECT year, unit, mid AS speed_mid_kmh, round(m, 6) AS median_accel, n AS n_samples FROM bins""",
)
def _(t):
    return rounded(N.speed_bins(N.pool_by_group(t.accel, UNITS), ["year", "unit"]))


@query(
    "pu_ranking",
    f"""WITH {BINS} SELECT year, unit, n_points, round(punch, 6) AS punch, round(hold, 6) AS hold, round(punch - hold, 6) AS fade,
    round(coalesce((punch + hold) / 2, punch, hold), 6) AS score,
    CAST(row_number() OVER (PARTITION BY year ORDER BY coalesce((punch + hold) / 2, punch, hold) DESC NULLS LAST, unit) AS INT) AS pu_rank FROM met""",
)
def _(t):
    return rounded(N.pu_ranking(t.accel, UNITS))


@query(
    "pu_verdict_rank",
    f"""WITH {BINS}, long AS (SELECT year, unit, 'punch' AS metric, 0 AS o, punch AS value, -punch AS b FROM met UNION ALL
      SELECT year, unit, 'hold', 1, hold, -hold FROM met UNION ALL SELECT year, unit, 'fade', 2, punch - hold, punch - hold FROM met),
    r AS (SELECT *, row_number() OVER (PARTITION BY year, metric ORDER BY b, unit) AS place FROM (
      SELECT *, count(*) OVER w AS total, max(value) OVER w - min(value) OVER w AS spread FROM long WHERE value IS NOT NULL WINDOW w AS (PARTITION BY year, metric))
      WHERE total >= 3 AND spread >= 0.05),
    e AS (SELECT *, CASE WHEN place = 1 OR place = total THEN 1.0 WHEN place = 2 AND metric <> 'fade' THEN 0.5 END::DOUBLE AS extremity FROM r)
    SELECT year, unit, metric, round(value, 6) AS value, CAST(place AS INT) AS place, total, extremity, CAST(row_number() OVER (PARTITION BY year, unit ORDER BY extremity DESC, o) AS INT) AS pick,
      printf('%s %d of %d (%+.1f)', metric, place, total, value) AS clause FROM e WHERE extremity IS NOT NULL QUALIFY pick <= 2""",
)
def _(t):
    return rounded(N.pu_verdict_rank(N.pu_ranking(t.accel, UNITS)))


def verdict_sql(column: int) -> str:
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v[column])}" for k, v in VERDICTS.items())
    return f"CASE metric || ' ' || said {cases} END"


@query(
    "pu_verdicts",
    f"""WITH {BINS}, p AS ({ORACLES["pu_verdict_rank"]}),
    said AS (SELECT p.year, p.unit, pick, metric, CASE WHEN place = 1 THEN 'first' WHEN place = total AND metric = 'hold' AND hold <= 0 THEN 'dry' WHEN place = total THEN 'last' ELSE 'second' END AS said, punch, hold
      FROM p JOIN met ON met.year = p.year AND met.unit = p.unit),
    told AS (SELECT year, unit, arg_min({verdict_sql(0)}, pick) AS headline,
      string_agg(replace(replace({verdict_sql(1)}, '{{punch}}', coalesce(printf('%+.1f', punch), '')), '{{hold}}', coalesce(printf('%+.1f', hold), '')), '; ' ORDER BY pick) AS told FROM said GROUP BY ALL)
    SELECT year, unit, CAST(row_number() OVER (PARTITION BY year ORDER BY punch DESC NULLS LAST, hold DESC NULLS LAST, unit) AS INT) AS place,
      unit || ' power ' || coalesce(headline, {sql_text(VERDICT_NONE[0])}) AS header, coalesce(upper(told[1:1]) || told[2:] || '.', {sql_text(VERDICT_NONE[1])}) AS explanation
    FROM met LEFT JOIN told USING (year, unit) WHERE (punch IS NOT NULL OR hold IS NOT NULL) AND year IN (SELECT year FROM p)""",
)
def _(t):
    return N.pu_verdicts(N.pu_ranking(t.accel, UNITS))


@query(
    "accel_scatter",
    """SELECT year, round, constructor, driver, lap_id, sample_idx, round(speed_kmh, 6) AS speed_kmh, round(accel_ms2, 6) AS accel_ms2 FROM
    (SELECT *, row_number() OVER (PARTITION BY year, constructor ORDER BY round, driver, lap_id, sample_idx) AS rn, count(*) OVER (PARTITION BY year, constructor) AS n FROM accel_pts)
    WHERE (rn - 1) % CAST(ceil(n / 2000) AS INT) = 0""",
)
def _(t):
    scatter = N.accel_scatter(t.accel, 2000)
    return rounded(scatter.drop("session_type"))


# --- reads ------------------------------------------------------------------


@query(
    "gap_to_team_ahead",
    f"""{INDEX_SQL}, g AS (SELECT *, last_value(lap_deficit_s IGNORE NULLS) OVER (PARTITION BY year, round ORDER BY overall_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM idx)
    SELECT year, round, constructor, overall_rank, round(lap_deficit_s, 6) AS lap_deficit_s,
      CASE WHEN lap_deficit_s IS NULL THEN NULL WHEN above IS NULL THEN 0 ELSE round_even(lap_deficit_s - above, 3) END AS gap_to_team_ahead_s,
      round_even(clean_median_s, 3) AS clean_air_median_s, round_even(clean_gap_s, 3) AS clean_air_gap_s, clean_laps AS clean_air_laps
    FROM g LEFT JOIN (SELECT * FROM team_clean_air WHERE session_type = 'R') c USING (year, round, constructor)""",
)
def _(t):
    from stintwise.operators.corners import constructor_index

    index = constructor_index(t.prints, t.race_pace)
    return rounded(R.gap_to_team_ahead(index, t.clean_air))


@query(
    "final_stint_delta",
    f"""SELECT {GK}, driver, stint_number, round(avg_pace_s, 6) AS avg_pace_s, round_even(avg_pace_s - min(avg_pace_s) OVER (PARTITION BY {GK}), 3) AS final_delta_s
    FROM (SELECT {GK}, driver, max(stint_number) AS stint_number, arg_max_null(a, stint_number) AS avg_pace_s FROM (
       SELECT l.year, l.round, l.session_type, l.driver, l.stint_number, avg(k.pace_s) AS a FROM (SELECT DISTINCT {GK}, driver, stint_number FROM laps WHERE driver IN (1, 3, 5)) l
       LEFT JOIN kept k USING ({GK}, driver, stint_number) GROUP BY ALL) GROUP BY ALL)""",
)
def _(t):
    return rounded(R.final_stint_delta(t.stints, [1, 3, 5]))


@query(
    "stints_of_driver",
    f"""SELECT {GK}, driver, stint_number, any_value(compound) AS compound, min(lap_number) AS lap_start, max(lap_number) AS lap_end
    FROM laps WHERE driver = 3 AND session_type = 'R' GROUP BY {GK}, driver, stint_number""",
)
def _(t):
    rows = R.stints_of_driver(t.stints, 3)
    return rows.select(
        *SESSION_KEYS, "driver", "stint_number", "compound", "lap_start", "lap_end"
    )


@query(
    "lap_evolution",
    f"SELECT {GK}, driver, stint_number, compound, lap_number, round(pace_s, 6) AS pace_s FROM kept WHERE driver = 3 AND stint_number = 1",
)
def _(t):
    return rounded(R.lap_evolution(t.kept, 3, 1))


@query(
    "gap_to_best",
    f"""SELECT {GK}, constructor, round(median_s - min(median_s) OVER w, 6) AS gap_s,
    round(CASE WHEN max(median_s) OVER w = min(median_s) OVER w THEN 0 ELSE (median_s - min(median_s) OVER w) / (max(median_s) OVER w - min(median_s) OVER w) END, 6) AS bar
    FROM team_pace WINDOW w AS (PARTITION BY {GK})""",
)
def _(t):
    return rounded(
        t.team_pace.select(
            *P.TEAM_KEYS,
            R.gap_to_best("median_s", SESSION_KEYS).alias("gap_s"),
            R.bar_fraction("median_s", SESSION_KEYS).alias("bar"),
        )
    )


HEAT = f"""SELECT {GK}, constructor, CAST(row_number() OVER (PARTITION BY {GK} ORDER BY median_s NULLS LAST, constructor) AS INT) AS up,
 CAST(row_number() OVER (PARTITION BY {GK} ORDER BY median_s DESC NULLS LAST, constructor) AS INT) AS down, count(*) OVER (PARTITION BY {GK}) AS n FROM team_pace"""


@query("rank_desc", f"SELECT {GK}, constructor, up AS rank_asc, down AS rank_desc FROM ({HEAT})")
def _(t):
    return t.team_pace.select(
        *P.TEAM_KEYS,
        Q.rank_asc("median_s", SESSION_KEYS).alias("rank_asc"),
        Q.rank_desc("median_s", SESSION_KEYS).alias("rank_desc"),
    )


@query(
    "heat_intensity",
    f"""SELECT {GK}, constructor, round(CASE WHEN n <= 1 THEN 0 ELSE pow(1 - (up - 1) / (n - 1), 3) * CAST(0.22 AS DOUBLE) END, 6) AS heat FROM ({HEAT})""",
)
def _(t):
    from pyspark.sql import Window

    total = F.count("*").over(Window.partitionBy(*SESSION_KEYS))
    rank = Q.rank_asc("median_s", SESSION_KEYS)
    return rounded(
        t.team_pace.select(*P.TEAM_KEYS, rank.alias("_r"), total.alias("_n")).select(
            *P.TEAM_KEYS, R.heat_intensity(F.col("_r"), F.col("_n")).alias("heat")
        )
    )


CITED = f"""SELECT year, round, driver AS cite_id, round(gap_to_leader_s % 5, 3) AS cited FROM results WHERE session_type = 'R' AND gap_to_leader_s IS NOT NULL"""


def cited(t):
    return t.results.where(
        (F.col("session_type") == "R") & F.col("gap_to_leader_s").isNotNull()
    ).select(
        *WEEKEND_KEYS,
        F.col("driver").alias("cite_id"),
        F.round(F.col("gap_to_leader_s") % 5, 3).alias("cited"),
    )


@query(
    "nearest_value",
    f"""WITH c AS ({CITED}) SELECT c.year, c.round, cite_id, cited, arg_min(constructor, (abs(gap_s - cited), constructor)) AS constructor,
    round(arg_min(gap_s, (abs(gap_s - cited), constructor)), 6) AS gap_s FROM c JOIN race_team_pace p USING (year, round) GROUP BY ALL""",
)
def _(t):
    measured = t.race_pace.select(*WEEKEND_KEYS, "constructor", "gap_s")
    near = R.nearest_value(cited(t), measured, WEEKEND_KEYS)
    return near.withColumn("gap_s", F.round(F.col("gap_s") + F.lit(1e-9), 6))


@query(
    "tolerance_match",
    f"""WITH c AS ({CITED}) SELECT year, round, cite_id, cited, EXISTS (SELECT 1 FROM race_team_pace p WHERE p.year = c.year AND p.round = c.round AND abs(p.gap_s - cited) <= 0.02) AS matched FROM c""",
)
def _(t):
    measured = t.race_pace.select(*WEEKEND_KEYS, F.col("gap_s").alias("measured"))
    return R.tolerance_match(cited(t), measured, WEEKEND_KEYS, 0.02)


STRATEGY = f"""SELECT {GK}, driver, string_agg(left(compound, 1), '-' ORDER BY stint_number) AS strategy
FROM (SELECT DISTINCT {GK}, driver, stint_number, compound FROM laps) GROUP BY ALL"""
LABEL = """CASE WHEN position = 1 THEN 'leader' WHEN status = 'Retired' THEN 'DNF'
 WHEN status = 'Lapped' OR laps < leader_laps THEN CASE WHEN leader_laps - laps > 1 THEN printf('+%d Laps', CAST(leader_laps - laps AS INT)) ELSE '+1 Lap' END
 WHEN gap_to_leader_s IS NOT NULL THEN printf('+%.1fs', gap_to_leader_s) ELSE status END"""


@query(
    "stint_result_join",
    f"SELECT {GK}, driver, position, {LABEL} AS gap_label, strategy FROM results LEFT JOIN ({STRATEGY}) USING ({GK}, driver)",
)
def _(t):
    return R.stint_result_join(t.results, t.stints)


@query(
    "session_summary",
    f"""SELECT {GK}, 'sector_best' AS kind, sector::VARCHAR AS item, driver, round(best_time_s, 6) AS value, constructor AS text, session_type IN ('FP1','FP2','FP3','SQ') AS indicative FROM sector_best
    UNION ALL SELECT {GK}, 'dominance', sector::VARCHAR, driver, round(margin_s, 6), constructor, session_type IN ('FP1','FP2','FP3','SQ') FROM dominance
    UNION ALL SELECT {GK}, 'top_speed', '', driver::BIGINT, round(max(max_speed_kmh), 6), min(constructor), session_type IN ('FP1','FP2','FP3','SQ') FROM zone_speed GROUP BY {GK}, driver
    UNION ALL SELECT {GK}, 'order', position::VARCHAR, driver, round(gap_to_leader_s, 6), {LABEL}, session_type IN ('FP1','FP2','FP3','SQ') FROM results""",
)
def _(t):
    tops = t.zones.groupBy(*SESSION_KEYS, "driver").agg(
        F.min("constructor").alias("constructor"), F.max("max_speed_kmh").alias("max_speed_kmh")
    )
    label = R.format_gap_label(
        F.col("position"), F.col("gap_to_leader_s"), F.col("laps"), F.col("leader_laps"), F.col("status")
    )
    order = t.results.withColumn("gap_label", label)
    dominance = Q.sector_dominance(t.sector_bests, SESSION_KEYS)
    return rounded(R.session_summary(t.sector_bests, dominance, tops, order))


@query(
    "clip_field_minimum",
    f"""SELECT *, min(total_clip_m) OVER (PARTITION BY {GK}) AS field_min_total_clip_m, min(max_clip_m) OVER (PARTITION BY {GK}) AS field_min_max_clip_m FROM clip_total""",
)
def _(t):
    return R.clip_field_minimum(t.stored("clips", lambda: t.clips))


@query(
    "digest_summary",
    f"""WITH w AS (SELECT r.year, r.round, driver AS winner, constructor AS winner_team FROM results r JOIN race_session s USING (year, round, session_type) WHERE position = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY gap_s, constructor) AS n FROM race_team_pace),
    pg AS (SELECT year, round, max(constructor) FILTER (WHERE n = 1) AS fastest_team, string_agg(constructor || ' ' || printf('+%.3fs', gap_s + 1e-9), '; ' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 4) AS next_gaps FROM p GROUP BY ALL HAVING count(*) >= 2),
    ts AS (SELECT year, round, sector, constructor, min(best_time_s) AS b, arg_min(driver, (best_time_s, driver)) AS d FROM sector_best WHERE session_type IN ('FP1','FP2','FP3','SQ') GROUP BY ALL),
    sh AS (SELECT year, round, string_agg('S' || sector || ' ' || constructor || ' ' || d, '; ' ORDER BY sector) AS sector_holders FROM (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY year, round, sector ORDER BY b, constructor) = 1) GROUP BY ALL),
    tp AS (SELECT year, round, max(max_speed_kmh) AS top_speed_kmh FROM zone_speed WHERE session_type IN ('FP1','FP2','FP3','SQ') GROUP BY ALL)
    SELECT c.year, c.round, event_name, winner, winner_team, fastest_team, next_gaps, sector_holders, round(top_speed_kmh, 6) AS top_speed_kmh
    FROM calendar c LEFT JOIN w USING (year, round) LEFT JOIN pg USING (year, round) LEFT JOIN sh USING (year, round) LEFT JOIN tp USING (year, round)""",
)
def _(t):
    indicative = t.sector_bests.where(F.col("session_type").isin(INDICATIVE))
    tops = t.zones.where(F.col("session_type").isin(INDICATIVE))
    return rounded(
        R.digest_summary(
            t.calendar.select(*WEEKEND_KEYS, "event_name"),
            t.results.join(C.pick_session(t.sessions, ["R", "SPRINT"]), SESSION_KEYS),
            t.race_pace,
            Q.sector_dominance(Q.best_across_sessions(indicative), WEEKEND_KEYS),
            tops,
        )
    )
