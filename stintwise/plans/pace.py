"""Lap, stint and pace queries."""

from pyspark.sql import functions as F

from stintwise.constants import RACE_LIKE, SESSION_KEYS
from stintwise.operators import laps as L
from stintwise.operators import pace as P
from stintwise.plans.columns import rounded
from stintwise.plans.registry import query

LAP = [*L.DRIVER_KEYS, "lap_number"]


@query(
    "landing_laps",
    """SELECT year, round, session_type, driver, constructor, lap_number, stint_number, tyre_age, compound,
       round(lap_time_s, 6) AS lap_time_s, is_accurate, deleted, track_status, is_outlap, is_inlap, rainfall,
       round(session_time_s, 6) AS session_time_s, position, round(sector1_s, 6) AS sector1_s,
       round(sector2_s, 6) AS sector2_s, round(sector3_s, 6) AS sector3_s FROM laps""",
)
def _(t):
    return rounded(t.laps)


FILTERED = """SELECT year, round, session_type, driver, lap_number, round(lap_time_s, 6) AS lap_time_s
FROM laps WHERE is_accurate AND NOT deleted AND NOT is_outlap AND NOT is_inlap AND NOT rainfall"""


@query("clean_laps", f"{FILTERED} AND track_status = '1'")
def _(t):
    return rounded(L.clean_laps(t.laps).select(*LAP, "lap_time_s"))


@query("representative_laps", FILTERED)
def _(t):
    return rounded(L.representative_laps(t.laps).select(*LAP, "lap_time_s"))


@query(
    "clean_lap_counts",
    f"""SELECT year, round, session_type, driver, count(*) AS clean_laps
    FROM ({FILTERED} AND track_status = '1') GROUP BY ALL""",
)
def _(t):
    return L.clean_lap_counts(t.laps)


@query(
    "pace_laps",
    """SELECT year, round, session_type, driver, lap_number, stint_number, tyre_age, compound,
    round(gap_s, 6) AS gap_s, round(pace_s, 6) AS pace_s FROM kept""",
)
def _(t):
    return rounded(
        L.pace_laps(L.gap_to_car_ahead(t.laps)).select(
            *LAP, "stint_number", "tyre_age", "compound", "gap_s", "pace_s"
        )
    )


@query(
    "clean_air_laps",
    """SELECT year, round, session_type, driver, lap_number, round(gap_s, 6) AS gap_s,
    round(pace_s, 6) AS pace_s FROM kept WHERE gap_s IS NULL OR gap_s >= 0.5""",
)
def _(t):
    return rounded(t.kept.where(L.clean_air()).select(*LAP, "gap_s", "pace_s"))


@query(
    "drop_opening_lap",
    """SELECT year, round, session_type, driver, lap_number, round(pace_s, 6) AS pace_s FROM paced""",
)
def _(t):
    return rounded(L.without_opening_lap(t.kept, t.laps).select(*LAP, "pace_s"))


@query(
    "gap_to_car_ahead",
    """SELECT year, round, session_type, driver, lap_number, position, round(gap_s, 6) AS gap_s FROM gapped""",
)
def _(t):
    return rounded(L.gap_to_car_ahead(t.laps).select(*LAP, "position", "gap_s"))


@query(
    "fuel_correction",
    """SELECT year, round, session_type, driver, lap_number, total_laps,
    round(CASE WHEN session_type IN ('R', 'SPRINT')
          THEN lap_time_s - CAST(0.025 AS DOUBLE) * 70 / total_laps * (total_laps - lap_number)
          ELSE lap_time_s END, 6) AS pace_s
    FROM (SELECT *, max(lap_number) OVER (PARTITION BY year, round, session_type) AS total_laps FROM laps)""",
)
def _(t):
    return rounded(L.fuel_corrected(t.laps).select(*LAP, "total_laps", "pace_s"))


@query(
    "stint_summary",
    """SELECT l.year, l.round, l.session_type, l.driver, l.stint_number, l.compound, l.constructor,
    l.lap_start, l.lap_end, round(k.avg_pace_s, 6) AS avg_pace_s, coalesce(k.kept_laps, 0) AS kept_laps
    FROM (SELECT year, round, session_type, driver, stint_number, min_by(compound, lap_number) AS compound,
          min(constructor) AS constructor, min(lap_number) AS lap_start, max(lap_number) AS lap_end
          FROM laps GROUP BY ALL) l
    LEFT JOIN (SELECT year, round, session_type, driver, stint_number, avg(pace_s) AS avg_pace_s,
               count(*) AS kept_laps FROM kept GROUP BY ALL) k
    USING (year, round, session_type, driver, stint_number)""",
)
def _(t):
    return rounded(L.stint_summary(L.gap_to_car_ahead(t.laps, prunable=True)))


@query(
    "sector_bests",
    """SELECT year, round, session_type, driver, constructor, sector, round(best_time_s, 6) AS best_time_s
    FROM sector_best""",
)
def _(t):
    return rounded(L.sector_bests(t.laps))


@query(
    "fastest_lap_per_driver",
    f"""SELECT * FROM ({FILTERED}) QUALIFY row_number() OVER (
    PARTITION BY year, round, session_type, driver ORDER BY lap_time_s, lap_number) = 1""",
)
def _(t):
    reps = L.representative_laps(t.laps).select(*LAP, "lap_time_s")
    return rounded(L.fastest_lap_per_driver(reps))


@query(
    "top5_laps_per_driver",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY year, round, session_type, driver
    ORDER BY lap_time_s, lap_number) AS INT) AS pick FROM ({FILTERED}) QUALIFY pick <= 5""",
)
def _(t):
    reps = L.representative_laps(t.laps).select(*LAP, "lap_time_s")
    return rounded(L.fastest_laps_per_driver(reps))


@query(
    "lap_weather_asof",
    """WITH weather AS (SELECT year, round, session_type, floor(session_time_s / 60) * 60 AS time_s,
       bool_or(rainfall) AS rainfall FROM laps GROUP BY ALL)
    SELECT l.year, l.round, l.session_type, l.driver, l.lap_number, w.rainfall AS rain_at_end
    FROM laps l ASOF LEFT JOIN weather w ON l.year = w.year AND l.round = w.round
     AND l.session_type = w.session_type AND l.session_time_s >= w.time_s""",
)
def _(t):
    return L.weather_asof(t.laps, t.weather).select(*LAP, "rain_at_end")


BOX = """
q AS (SELECT {keys}, quantile_cont(pace_s, 0.1) AS pace_ceiling_s, quantile_cont(pace_s, 0.25) AS q1_s,
  quantile_cont(pace_s, 0.5) AS median_s, quantile_cont(pace_s, 0.75) AS q3_s, count(*) AS n_laps,
  avg(pace_s) AS mean_s FROM paced WHERE {where} GROUP BY ALL),
f AS (SELECT p.*, q.* EXCLUDE ({keys}), p.pace_s BETWEEN q1_s - 1.5 * (q3_s - q1_s) AND q3_s + 1.5 * (q3_s - q1_s)
      AS in_fence FROM paced p JOIN q USING ({keys}))"""


def box_sql(keys: str, where: str = "true") -> str:
    return f"""WITH {BOX.format(keys=keys, where=where)},
    first_run AS (SELECT {keys}, compound, min(stint_number * 1000000 + driver) AS seen
                  FROM paced WHERE {where} GROUP BY ALL),
    tags AS (SELECT {keys}, string_agg(left(compound, 1), ',' ORDER BY seen) AS compounds
             FROM first_run GROUP BY ALL),
    box AS (SELECT {keys}, max(pace_ceiling_s) AS pace_ceiling_s, max(q1_s) AS q1_s, max(median_s) AS median_s,
      max(q3_s) AS q3_s, max(n_laps) AS n_laps, max(mean_s) AS mean_s,
      coalesce(min(pace_s) FILTER (WHERE in_fence), min(pace_s)) AS whisker_low_s,
      coalesce(max(pace_s) FILTER (WHERE in_fence), max(pace_s)) AS whisker_high_s,
      count(*) FILTER (WHERE NOT in_fence) AS n_outliers FROM f GROUP BY ALL)"""


BOX_COLUMNS = """round(pace_ceiling_s, 6) AS pace_ceiling_s, round(q1_s, 6) AS q1_s,
 round(median_s, 6) AS median_s, round(q3_s, 6) AS q3_s, n_laps, round(mean_s, 6) AS mean_s,
 round(whisker_low_s, 6) AS whisker_low_s, round(whisker_high_s, 6) AS whisker_high_s, n_outliers, compounds"""
TEAM = "year, round, session_type, constructor"
DRIVER = "year, round, session_type, driver"


@query(
    "box_stats",
    f"""{box_sql(TEAM + ", stint_number")} SELECT {TEAM}, stint_number, {BOX_COLUMNS}
    FROM box JOIN tags USING ({TEAM}, stint_number)""",
)
def _(t):
    return rounded(P.box_stats(t.paced, [*P.TEAM_KEYS, "stint_number"]))


@query(
    "box_outliers",
    f"""{box_sql(TEAM)} SELECT {TEAM}, driver, lap_number, round(pace_s, 6) AS pace_s FROM f
    WHERE NOT in_fence""",
)
def _(t):
    return rounded(
        P.outlier_laps(t.paced, P.TEAM_KEYS).select(
            *P.TEAM_KEYS, "driver", "lap_number", "pace_s"
        )
    )


@query(
    "driver_pace",
    f"""{box_sql(DRIVER)} SELECT {DRIVER}, {BOX_COLUMNS},
    round(median_s - min(median_s) OVER (PARTITION BY year, round, session_type), 6) AS gap_s
    FROM box JOIN tags USING ({DRIVER})""",
)
def _(t):
    return rounded(P.pace_rows(t.paced, L.DRIVER_KEYS)).orderBy(*SESSION_KEYS, "median_s")


@query(
    "constructor_pace",
    f"""{box_sql(TEAM)} SELECT {TEAM}, {BOX_COLUMNS},
    round(median_s - min(median_s) OVER (PARTITION BY year, round, session_type), 6) AS gap_s
    FROM box JOIN tags USING ({TEAM})""",
)
def _(t):
    return rounded(P.pace_rows(t.paced, P.TEAM_KEYS)).orderBy(*SESSION_KEYS, "median_s")


@query(
    "constructor_median_gaps",
    f"""SELECT {TEAM}, round(median_s, 6) AS median_s, n_laps, round(gap_s, 6) AS gap_s
    FROM team_pace WHERE session_type IN ('R', 'SPRINT')""",
)
def _(t):
    races = t.paced.where(F.col("session_type").isin(RACE_LIKE))
    return rounded(P.constructor_median_gaps(races)).orderBy(*SESSION_KEYS, "gap_s")


@query(
    "clean_air_pace",
    f"""SELECT {TEAM}, round(clean_median_s, 6) AS clean_median_s, clean_laps,
    round(clean_gap_s, 6) AS clean_gap_s, round(median_s, 6) AS median_s, round(gap_s, 6) AS gap_s
    FROM team_clean_air JOIN team_pace USING ({TEAM})""",
)
def _(t):
    return rounded(P.clean_air_pace(t.paced))


@query(
    "stop_counts",
    f"SELECT {DRIVER}, count(DISTINCT stint_number) - 1 AS stops FROM laps GROUP BY ALL",
)
def _(t):
    return P.stop_counts(t.laps)


@query(
    "stop_spread",
    f"""SELECT year, round, session_type, CASE WHEN count(*) < 2 THEN 0 ELSE max(stops) - min(stops) END AS stop_spread
    FROM (SELECT {DRIVER}, count(DISTINCT stint_number) - 1 AS stops FROM laps GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    return P.stop_spread(t.laps)


@query(
    "theil_sen",
    f"SELECT {TEAM}, compound, driver, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_laps FROM unit_fit",
)
def _(t):
    return rounded(P.driver_fits(t.paced))


@query(
    "degradation_fits",
    f"""SELECT {TEAM}, compound, round(slope_s_per_lap, 6) AS slope_s_per_lap, round(intercept_s, 6) AS intercept_s,
    round(cost_s, 6) AS cost_s, n_laps, flagged FROM wear""",
)
def _(t):
    return rounded(P.degradation_fits(t.paced))


@query(
    "degradation_fits_pooled",
    f"""WITH unit AS (SELECT {TEAM}, compound, quantile_cont(s, 0.5) AS slope FROM (
      SELECT {", ".join("a." + c for c in TEAM.split(", "))}, a.compound, (b.pace_s - a.pace_s) / (b.tyre_age - a.tyre_age) AS s
      FROM paced a JOIN paced b ON a.year = b.year AND a.round = b.round AND a.session_type = b.session_type
       AND a.constructor = b.constructor AND a.compound = b.compound AND a.tyre_age < b.tyre_age) GROUP BY ALL),
    fit AS (SELECT {TEAM}, compound, any_value(slope) AS slope, quantile_cont(pace_s - slope * tyre_age, 0.5) AS intercept, count(*) AS n_laps
      FROM paced JOIN unit USING ({TEAM}, compound) GROUP BY ALL HAVING count(*) >= 5),
    ref AS (SELECT year, round, session_type, compound, quantile_cont(slope, 0.5) AS f FROM fit WHERE slope > 0 GROUP BY ALL)
    SELECT {TEAM}, compound, round(slope, 6) AS slope_s_per_lap, round(intercept, 6) AS intercept_s,
      round(slope * 13, 6) AS cost_s, n_laps, coalesce(slope >= 1.5 * f AND f > 0, false) AS flagged
    FROM fit LEFT JOIN ref USING (year, round, session_type, compound)""",
)
def _(t):
    return rounded(
        P.degradation_fits(t.paced, pooled=True).withColumn("n_laps", F.col("n_laps").cast("bigint"))
    )


@query(
    "age_range",
    f"SELECT {TEAM}, min(tyre_age) AS min_age, max(tyre_age) AS max_age FROM paced GROUP BY ALL",
)
def _(t):
    return P.age_range(t.paced)


@query(
    "ols_fit",
    f"""SELECT {TEAM}, compound, round(regr_slope(pace_s, tyre_age), 6) AS slope,
    round(regr_intercept(pace_s, tyre_age), 6) AS intercept, count(*) AS n_points FROM paced GROUP BY ALL""",
)
def _(t):
    return rounded(P.ols_fit(t.paced, [*P.TEAM_KEYS, "compound"], "tyre_age", "pace_s"))
