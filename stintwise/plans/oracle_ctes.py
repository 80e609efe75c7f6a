"""Shared CTEs of the checking SQL: the landed tables and common steps, in plain SQL."""

CTES: dict[str, str] = {
    "lap_base": """
SELECT CAST(year(l_shipdate) AS INT) AS year,
       CAST(CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS INT) AS round,
       CASE WHEN quarter(l_shipdate) IN (1, 3) THEN CASE WHEN l_linestatus = 'F' THEN 'FP1' ELSE 'Q' END
            ELSE CASE WHEN l_returnflag = 'R' THEN 'SPRINT' ELSE 'R' END END AS session_type,
       l_suppkey AS driver, n_name AS constructor,
       l_quantity, l_discount, l_tax, l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "lap_numbered": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY year, round, session_type, driver
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS lap_number
FROM lap_base""",
    "lap_aged": """
SELECT *, CAST(floor((lap_number - 1) / 8.0) AS INT) + 1 AS stint_number,
       CAST((lap_number - 1) % 8 AS INT) + 1 AS tyre_age FROM lap_numbered""",
    "lap_timed": """
SELECT year, round, session_type, driver, constructor, lap_number, stint_number, tyre_age,
       CASE (driver + stint_number) % 3 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound,
       round(CAST(80 AS DOUBLE) + l_quantity / 10 + CAST(0.05 AS DOUBLE) * tyre_age, 3) AS lap_time_s,
       round(l_discount * 100) < 10 AS is_accurate,
       (round(l_tax * 100) = 8 AND l_returnflag = 'R') AS deleted,
       CASE WHEN round(l_tax * 100) = 7 THEN '4' ELSE '1' END AS track_status,
       (tyre_age = 1 AND stint_number > 1) AS is_outlap,
       (tyre_age = 8) AS is_inlap,
       round(l_discount * 100) = 9 AS rainfall FROM lap_aged""",
    "lap_clocked": """
SELECT *, round(SUM(lap_time_s) OVER (PARTITION BY year, round, session_type, driver ORDER BY lap_number
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS session_time_s FROM lap_timed""",
    "lap_placed": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY year, round, session_type, lap_number
          ORDER BY session_time_s, driver) AS position,
       lap_time_s * CAST(0.30 AS DOUBLE) + (lap_number % 3) / CAST(100 AS DOUBLE) AS sector1_s,
       lap_time_s * CAST(0.36 AS DOUBLE) + (lap_number % 5) / CAST(100 AS DOUBLE) AS sector2_s
FROM lap_clocked""",
    "laps": "SELECT *, lap_time_s - sector1_s - sector2_s AS sector3_s FROM lap_placed",
    "gapped": """
SELECT *, session_time_s - lag(session_time_s) OVER (PARTITION BY year, round, session_type, lap_number
          ORDER BY position) AS gap_s FROM laps""",
    "kept": """
SELECT g.*, CASE WHEN session_type IN ('R', 'SPRINT')
            THEN lap_time_s - CAST(0.025 AS DOUBLE) * 70 / total_laps * (total_laps - lap_number)
            ELSE lap_time_s END AS pace_s
FROM (SELECT *, max(lap_number) OVER (PARTITION BY year, round, session_type) AS total_laps FROM gapped) g
WHERE NOT is_outlap AND NOT is_inlap AND is_accurate AND NOT deleted
  AND coalesce(track_status, '1') = '1' AND lap_time_s IS NOT NULL""",
    "stint_span": """
SELECT year, round, session_type, driver, stint_number, min(lap_number) AS lap_start
FROM laps GROUP BY ALL""",
    "paced": """
SELECT * EXCLUDE (rn, lap_start) FROM (
  SELECT k.*, s.lap_start, row_number() OVER (
    PARTITION BY k.year, k.round, k.session_type, k.driver, k.stint_number ORDER BY k.lap_number) AS rn
  FROM kept k JOIN stint_span s USING (year, round, session_type, driver, stint_number))
WHERE NOT (stint_number = 1 AND lap_start = 1 AND rn = 1)""",
    "team_pace": """
SELECT year, round, session_type, constructor, median_s, n_laps,
       median_s - min(median_s) OVER (PARTITION BY year, round, session_type) AS gap_s
FROM (SELECT year, round, session_type, constructor, quantile_cont(pace_s, 0.5) AS median_s,
             count(*) AS n_laps FROM paced GROUP BY ALL)""",
    "team_clean_air": """
SELECT year, round, session_type, constructor, clean_median_s, clean_laps,
       clean_median_s - min(clean_median_s) OVER (PARTITION BY year, round, session_type) AS clean_gap_s
FROM (SELECT year, round, session_type, constructor, quantile_cont(pace_s, 0.5) AS clean_median_s,
             count(*) AS clean_laps FROM paced WHERE gap_s IS NULL OR gap_s >= 0.5 GROUP BY ALL)""",
    "done": """
SELECT year, round, session_type, driver, min(constructor) AS constructor, max(lap_number) AS laps,
       max(session_time_s) AS clock_s,
       min(lap_time_s) FILTER (WHERE stint_number = 1) AS q1_time_s,
       min(lap_time_s) FILTER (WHERE stint_number = 2) AS q2_time_s,
       min(lap_time_s) FILTER (WHERE stint_number = 3) AS q3_time_s
FROM laps GROUP BY ALL""",
    "classified": """
SELECT *, row_number() OVER (PARTITION BY year, round, session_type
          ORDER BY laps DESC, clock_s, driver) AS position FROM done""",
    "led": """
SELECT *, max(CASE WHEN position = 1 THEN laps END) OVER (PARTITION BY year, round, session_type) AS lead_laps,
       max(CASE WHEN position = 1 THEN clock_s END) OVER (PARTITION BY year, round, session_type) AS lead_clock
FROM classified""",
    "results": """
SELECT year, round, session_type, driver, constructor, position, CAST(laps AS DOUBLE) AS laps, status,
       CAST(lead_laps AS DOUBLE) AS leader_laps,
       CASE WHEN session_type NOT IN ('R', 'SPRINT') THEN NULL WHEN position = 1 THEN 0.0
            WHEN status = 'Lapped' OR laps < lead_laps THEN NULL ELSE clock_s - lead_clock END::DOUBLE AS gap_to_leader_s,
       CASE WHEN session_type IN ('R', 'SPRINT') AND position = 1 THEN clock_s END AS total_time_s,
       CASE WHEN session_type IN ('Q', 'SQ') THEN q1_time_s END AS q1_time_s,
       CASE WHEN session_type IN ('Q', 'SQ') THEN q2_time_s END AS q2_time_s,
       CASE WHEN session_type IN ('Q', 'SQ') THEN q3_time_s END AS q3_time_s
FROM (SELECT *, CASE WHEN driver % 17 = 0 THEN 'Retired' WHEN laps < lead_laps THEN 'Lapped'
             ELSE 'Finished' END AS status FROM led)""",
    "sector_best": """
SELECT year, round, session_type, driver, constructor, sector, min(t) AS best_time_s
FROM (SELECT *, 1 AS sector, sector1_s AS t FROM laps WHERE NOT deleted
      UNION ALL SELECT *, 2, sector2_s FROM laps WHERE NOT deleted
      UNION ALL SELECT *, 3, sector3_s FROM laps WHERE NOT deleted)
WHERE t IS NOT NULL GROUP BY ALL""",
    "cal_base": """
SELECT year, round, year * 2 + round AS number, min(l_shipdate) AS event_date,
       min(CASE WHEN session_type = 'FP1' THEN l_shipdate END) AS d_fp1,
       min(CASE WHEN session_type = 'Q' THEN l_shipdate END) AS d_q,
       min(CASE WHEN session_type = 'SPRINT' THEN l_shipdate END) AS d_sprint,
       min(CASE WHEN session_type = 'R' THEN l_shipdate END) AS d_r
FROM lap_base GROUP BY ALL""",
    "calendar": """
SELECT year, round, 'Grand Prix ' || year || '-' || round AS event_name,
       CASE WHEN number % 3 = 0 THEN 'Italy' ELSE 'Spain' END AS country,
       CASE number % 4 WHEN 0 THEN 'Monza' WHEN 1 THEN 'Barcelona' WHEN 2 THEN 'Imola' ELSE 'Nowhere' END AS location,
       event_date,
       'Practice 1' AS session1, CASE WHEN number % 2 = 0 THEN 'Sprint Shootout' ELSE 'Filming Day' END AS session2,
       'Qualifying' AS session3, 'Sprint' AS session4, CASE WHEN number % 5 <> 0 THEN 'Race' END AS session5,
       d_fp1 AS session1_date_utc, CAST(NULL AS TIMESTAMP) AS session2_date_utc, d_q AS session3_date_utc,
       CAST(NULL AS TIMESTAMP) AS session4_date_utc,
       CASE WHEN number % 3 <> 0 THEN d_r END AS session5_date_utc,
       d_fp1 + INTERVAL 1 HOUR AS session1_date, d_sprint AS session2_date, d_q AS session3_date,
       d_sprint + INTERVAL 1 HOUR AS session4_date, CASE WHEN number % 2 = 0 THEN d_r END AS session5_date
FROM cal_base""",
    "scheduled": """
SELECT year, round, slot, name, code, start_utc FROM (
  SELECT year, round, slot, name, start_utc,
         CASE name WHEN 'Practice 1' THEN 'FP1' WHEN 'Practice 2' THEN 'FP2' WHEN 'Practice 3' THEN 'FP3'
              WHEN 'Qualifying' THEN 'Q' WHEN 'Sprint Qualifying' THEN 'SQ' WHEN 'Sprint Shootout' THEN 'SQ'
              WHEN 'Sprint' THEN 'SPRINT' WHEN 'Race' THEN 'R' END AS code
  FROM (SELECT year, round, 1 AS slot, session1 AS name, coalesce(session1_date_utc, session1_date) AS start_utc FROM calendar
        UNION ALL SELECT year, round, 2, session2, coalesce(session2_date_utc, session2_date) FROM calendar
        UNION ALL SELECT year, round, 3, session3, coalesce(session3_date_utc, session3_date) FROM calendar
        UNION ALL SELECT year, round, 4, session4, coalesce(session4_date_utc, session4_date) FROM calendar
        UNION ALL SELECT year, round, 5, session5, coalesce(session5_date_utc, session5_date) FROM calendar))
WHERE code IS NOT NULL""",
    "season_events": """
SELECT year, round, event_name, country, location,
       coalesce(session5_date_utc, session5_date, event_date) AS event_start FROM calendar
WHERE coalesce(session5_date_utc, session5_date, event_date) IS NOT NULL""",
    "race_session": """
SELECT year, round, min_by(session_type, CASE session_type WHEN 'R' THEN 1 ELSE 2 END) AS session_type
FROM (SELECT DISTINCT year, round, session_type FROM laps WHERE session_type IN ('R', 'SPRINT')) GROUP BY ALL""",
    "tlap": """
SELECT vec_id AS lap_id, CAST(2000 AS INT) AS year, CAST(vec_id % 2 + 1 AS INT) AS round,
       CASE (vec_id // 2) % 3 WHEN 0 THEN 'FP1' WHEN 1 THEN 'Q' ELSE 'R' END AS session_type,
       label AS driver, n_name AS constructor,
       CASE WHEN (vec_id // 6) % 10 < 7 THEN 'SOFT' ELSE 'MEDIUM' END AS compound,
       CAST(80 AS DOUBLE) + (vec_id % 4) * CAST(0.5 AS DOUBLE) + CASE WHEN vec_id % 29 = 0 THEN 4 ELSE 0 END AS step,
       vec_id % 11 <> 0 AS is_representative, vec_id % 13 <> 0 AS is_clean, embedding,
       CAST(80 AS DOUBLE) + list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding) * 10 AS lap_time_s
FROM embeddings JOIN nation ON label // 2 = n_nationkey""",
    "tel": """
SELECT lap_id, year, round, session_type, driver, constructor, compound, is_representative, is_clean,
       lap_time_s, step, embedding, CAST(i AS INT) AS sample_idx,
       (i - 1) * step AS distance_m,
       CAST(230 AS DOUBLE) + CAST(300 AS DOUBLE) * CAST(embedding[i] AS DOUBLE) AS speed_kmh,
       CASE WHEN CAST(embedding[i] AS DOUBLE) > -0.1 THEN CAST(100 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS throttle,
       CAST(embedding[i] AS DOUBLE) < -0.2 AS brake,
       CAST(i - 1 AS DOUBLE) / 10 AS time_s,
       floor((CAST(230 AS DOUBLE) + CAST(300 AS DOUBLE) * CAST(embedding[i] AS DOUBLE)) / 50) AS gear
FROM tlap, range(1, 65) t(i)""",
    "corners": """
SELECT * FROM (VALUES (1, 400.0::DOUBLE), (2, 1200.0), (3, 2000.0), (4, 2800.0), (5, 3600.0), (6, 4400.0)) c(corner_number, at_m)""",
    "fast_rep": """
SELECT * FROM tlap WHERE is_representative
QUALIFY row_number() OVER (PARTITION BY year, round, session_type, driver ORDER BY lap_time_s, lap_id) = 1""",
    "fast_clean": """
SELECT * FROM tlap WHERE is_clean
QUALIFY row_number() OVER (PARTITION BY year, round, session_type, driver ORDER BY lap_time_s, lap_id) = 1""",
    "unit_slope": """
SELECT a.year, a.round, a.session_type, a.constructor, a.compound, a.driver,
       quantile_cont((b.pace_s - a.pace_s) / (b.tyre_age - a.tyre_age), 0.5) AS slope
FROM paced a JOIN paced b ON a.year = b.year AND a.round = b.round AND a.session_type = b.session_type
  AND a.driver = b.driver AND a.compound = b.compound AND a.tyre_age < b.tyre_age GROUP BY ALL""",
    "unit_fit": """
SELECT p.year, p.round, p.session_type, p.constructor, p.compound, p.driver, any_value(slope) AS slope,
       quantile_cont(pace_s - slope * tyre_age, 0.5) AS intercept, count(*) AS n_laps
FROM paced p JOIN unit_slope USING (year, round, session_type, constructor, compound, driver)
GROUP BY ALL HAVING count(*) >= 5""",
    "team_fit": """
SELECT year, round, session_type, constructor, compound, quantile_cont(slope, 0.5) AS slope_s_per_lap,
       quantile_cont(intercept, 0.5) AS intercept_s, CAST(sum(n_laps) AS BIGINT) AS n_laps
FROM unit_fit GROUP BY ALL""",
    "wear": """
SELECT t.*, slope_s_per_lap * 13 AS cost_s,
       coalesce(ref_slope > 0 AND slope_s_per_lap >= 1.5 * ref_slope, false) AS flagged
FROM team_fit t LEFT JOIN (SELECT year, round, session_type, compound, quantile_cont(slope_s_per_lap, 0.5) AS ref_slope
  FROM team_fit WHERE slope_s_per_lap > 0 GROUP BY ALL) f USING (year, round, session_type, compound)""",
    "race_team_pace": """
SELECT * FROM team_pace WHERE (year, round, session_type) IN (SELECT (year, round, session_type) FROM race_session)""",
    "items": """
SELECT year, round, CAST(slot AS INT) AS slot, constructor, printf('%s ran %.3f seconds off the pace', constructor, gap_s + 1e-9) AS header
FROM (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY gap_s DESC, constructor) AS slot
      FROM race_team_pace) WHERE slot <= 3""",
    "corner_speed": """
SELECT lap_id, year, round, session_type, driver, constructor, compound, is_clean, is_representative, lap_time_s,
       corner_number, min(speed_kmh) AS min_speed_kmh
FROM tel JOIN corners ON distance_m BETWEEN at_m - 75 AND at_m + 75 GROUP BY ALL""",
    "prints": """
SELECT year, round, session_type, driver, constructor, corner_number, compound,
       avg(min_speed_kmh) AS min_speed_kmh, count(*) AS clean_laps
FROM corner_speed WHERE is_clean GROUP BY ALL""",
    "driver_corner": """
SELECT year, round, session_type, corner_number, constructor, driver,
       sum(min_speed_kmh * clean_laps) / sum(clean_laps) AS metric, CAST(sum(clean_laps) AS BIGINT) AS laps
FROM prints WHERE clean_laps >= 5 GROUP BY ALL""",
    "team_corner": """
SELECT year, round, session_type, corner_number, constructor, avg(metric) AS car_kmh,
       CASE WHEN count(*) >= 2 THEN max(metric) - min(metric) END AS spread, min(laps) AS min_laps,
       count(*) >= 2 AND min(least(1.0, laps / 8)) >= 0.6 AS reliable
FROM driver_corner GROUP BY ALL""",
    "attribution": """
SELECT year, round, session_type, corner_number, constructor_a, constructor_b, delta_kmh,
       CASE WHEN mean_kmh < 125 THEN 'low' WHEN mean_kmh < 200 THEN 'mid' ELSE 'high' END AS speed_class,
       car_pct, 1 - car_pct AS driver_pct, conf * CASE WHEN both_reliable THEN 1.0 ELSE 0.5 END AS confidence
FROM (SELECT a.year, a.round, a.session_type, a.corner_number, a.constructor AS constructor_a, b.constructor AS constructor_b,
        a.car_kmh - b.car_kmh AS delta_kmh, (a.car_kmh + b.car_kmh) / 2 AS mean_kmh,
        a.reliable AND b.reliable AS both_reliable, least(CAST(1 AS DOUBLE), least(a.min_laps, b.min_laps) / 8) AS conf,
        CASE WHEN abs(a.car_kmh - b.car_kmh) + sp = 0 THEN 1.0
             ELSE abs(a.car_kmh - b.car_kmh) / (abs(a.car_kmh - b.car_kmh) + sp) END AS car_pct
      FROM team_corner a JOIN team_corner b ON a.year = b.year AND a.round = b.round AND a.session_type = b.session_type
        AND a.corner_number = b.corner_number AND a.constructor < b.constructor,
      LATERAL (SELECT coalesce(CASE WHEN a.spread IS NULL THEN b.spread WHEN b.spread IS NULL THEN a.spread
               ELSE (a.spread + b.spread) / 2 END, 0) AS sp))""",
    "zones": """
SELECT corner_number AS zone, lag(at_m) OVER (ORDER BY at_m) + 50 AS lo, at_m - 50 AS hi FROM corners
QUALIFY lo IS NOT NULL""",
    "zone_speed": """
SELECT lap_id, year, round, session_type, driver, constructor, zone,
       max(speed_kmh) AS max_speed_kmh, arg_max(speed_kmh, distance_m) AS trap_speed_kmh
FROM (SELECT t.*, z.zone - 1 AS zone FROM tel t JOIN zones z ON t.distance_m BETWEEN z.lo AND z.hi
      UNION ALL SELECT t.*, 0 FROM tel t WHERE distance_m >= 4450 OR distance_m <= 350)
WHERE lap_id IN (SELECT lap_id FROM fast_clean) GROUP BY ALL""",
    "quali_row": """
SELECT lap_id, year, round, session_type, driver, constructor, lap_time_s, max(speed_kmh) AS top_speed_kmh, min(speed_kmh) AS min_speed_kmh,
       coalesce(count(*) FILTER (WHERE throttle BETWEEN 99 AND 100) / nullif(count(*) FILTER (WHERE throttle <= 100), 0), 0) AS full_throttle_share
FROM tel WHERE lap_id IN (SELECT lap_id FROM fast_rep) GROUP BY ALL""",
    "quali_rep": """
SELECT * FROM quali_row
QUALIFY row_number() OVER (PARTITION BY year, round, session_type, constructor ORDER BY lap_time_s, driver) = 1""",
    "team_sector": """
SELECT year, round, session_type, sector, constructor, min(best_time_s) AS best_time_s, arg_min(driver, (best_time_s, driver)) AS driver
FROM sector_best GROUP BY ALL""",
    "dominance": """
SELECT * FROM (SELECT *, row_number() OVER w AS place, lead(best_time_s) OVER w - best_time_s AS margin_s FROM team_sector
  WINDOW w AS (PARTITION BY year, round, session_type, sector ORDER BY best_time_s, constructor)) WHERE place = 1""",
    "season_pace": "SELECT year, round, constructor, gap_s AS value FROM race_team_pace",
    "season_qgap": """
SELECT year, round, constructor, (lap_time_s - min(lap_time_s) OVER p) / min(lap_time_s) OVER p * 100 AS value
FROM quali_rep WHERE session_type = 'Q' WINDOW p AS (PARTITION BY year, round)""",
    "season_qtop": """
SELECT year, round, constructor, max(top) OVER (PARTITION BY year, round) - top AS value
FROM (SELECT year, round, constructor, max(top_speed_kmh) AS top FROM quali_row WHERE session_type = 'Q' GROUP BY ALL)""",
    "season_cal": "SELECT year, max(round) AS cur, count(DISTINCT round) AS n_rounds FROM lap_base GROUP BY year",
    "race_wear": """
SELECT * FROM wear WHERE (year, round, session_type) IN (SELECT (year, round, session_type) FROM race_session)""",
    "season_ref": """
SELECT year, arg_min(compound, (-n, compound)) AS ref FROM (SELECT year, compound, sum(n_laps) AS n FROM race_wear GROUP BY ALL) GROUP BY year""",
    "season_deg": """
SELECT year, constructor, coalesce(quantile_cont(slope_s_per_lap, 0.5) FILTER (WHERE compound = ref), quantile_cont(slope_s_per_lap, 0.5)) AS tyre_deg_s_per_lap
FROM race_wear JOIN season_ref USING (year) GROUP BY ALL""",
    "pace_agg": """
SELECT year, constructor, sum(pow(0.5, (cur - round) / CAST(6 AS DOUBLE)) * value) / sum(pow(0.5, (cur - round) / CAST(6 AS DOUBLE))) AS pace_mean,
  stddev_pop(value) AS pace_spread, count(*) AS pace_n FROM season_pace JOIN season_cal USING (year) GROUP BY ALL""",
    "quali_agg": """
SELECT year, constructor, sum(pow(0.5, (cur - round) / CAST(6 AS DOUBLE)) * value) / sum(pow(0.5, (cur - round) / CAST(6 AS DOUBLE))) AS quali_mean,
  stddev_pop(value) AS quali_spread, count(*) AS quali_n FROM season_qgap JOIN season_cal USING (year) GROUP BY ALL""",
    "season_norm": """
SELECT year, constructor, CASE WHEN pace_mean IS NULL THEN NULL WHEN phi = plo THEN 0 ELSE (pace_mean - plo) / (phi - plo) END AS np,
  CASE WHEN quali_mean IS NULL THEN NULL WHEN qhi = qlo THEN 0 ELSE (quali_mean - qlo) / (qhi - qlo) END AS nq
FROM (SELECT *, min(pace_mean) OVER y AS plo, max(pace_mean) OVER y AS phi, min(quali_mean) OVER y AS qlo, max(quali_mean) OVER y AS qhi
      FROM pace_agg FULL JOIN quali_agg USING (year, constructor) WINDOW y AS (PARTITION BY year))""",
    "season_rank": """
SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY score, constructor) AS INT) AS overall_rank
FROM (SELECT year, constructor, coalesce(CAST(0.6 AS DOUBLE) * np + CAST(0.4 AS DOUBLE) * nq, np, nq) AS score FROM season_norm) WHERE score IS NOT NULL""",
    "season_seen": """
SELECT year, constructor, count(DISTINCT round) AS seen FROM (SELECT * FROM season_pace UNION ALL SELECT * FROM season_qgap) GROUP BY ALL""",
    "snapshot": """
SELECT year, constructor, overall_rank, pace_mean, pace_spread, coalesce(pace_n, 0) AS pace_n, quali_mean, quali_spread, coalesce(quali_n, 0) AS quali_n,
  top_speed_deficit_kmh, top_speed_deficit_kmh * CAST(0.621371 AS DOUBLE) AS top_speed_deficit_mph, coalesce(sector_dominance_count, 0) AS sector_dominance_count, tyre_deg_s_per_lap,
  CASE WHEN coalesce(seen, 0) / n_rounds >= 0.75 THEN 'high' WHEN coalesce(seen, 0) / n_rounds >= 0.4 THEN 'med' ELSE 'low' END AS confidence
FROM pace_agg FULL JOIN quali_agg USING (year, constructor)
FULL JOIN (SELECT year, constructor, avg(value) AS top_speed_deficit_kmh FROM season_qtop GROUP BY ALL) USING (year, constructor)
FULL JOIN (SELECT year, constructor, count(*) AS sector_dominance_count FROM dominance WHERE session_type = 'Q' GROUP BY ALL) USING (year, constructor)
FULL JOIN season_deg USING (year, constructor) FULL JOIN season_seen USING (year, constructor)
LEFT JOIN season_rank USING (year, constructor) JOIN season_cal USING (year)""",
    "blend": """
SELECT year, round, constructor, coalesce(CAST(0.6 AS DOUBLE) * np + CAST(0.4 AS DOUBLE) * nq, np, nq) AS value
FROM (SELECT year, round, constructor, CASE WHEN p IS NULL THEN NULL WHEN max(p) OVER y = min(p) OVER y THEN 0 ELSE (p - min(p) OVER y) / (max(p) OVER y - min(p) OVER y) END AS np,
        CASE WHEN q IS NULL THEN NULL WHEN max(q) OVER y = min(q) OVER y THEN 0 ELSE (q - min(q) OVER y) / (max(q) OVER y - min(q) OVER y) END AS nq
      FROM (SELECT year, round, constructor, a.value AS p, b.value AS q FROM season_pace a FULL JOIN season_qgap b USING (year, round, constructor))
      WINDOW y AS (PARTITION BY year, round))""",
    "trends": """
SELECT *, 'pace' AS metric FROM season_pace UNION ALL SELECT *, 'quali' FROM season_qgap UNION ALL SELECT *, 'cumulative' FROM blend""",
    "band_fits": """
SELECT year, round, constructor, regr_slope(accel_ms2, speed_kmh) AS slope, regr_intercept(accel_ms2, speed_kmh) AS intercept, count(*) AS n_points
FROM accel_pts WHERE speed_kmh BETWEEN 150 AND 250 GROUP BY ALL HAVING count(*) >= 8""",
    "sig_corner": """
SELECT year, round, 'corner_delta' AS signal_type, 'corner' AS category, abs(delta_kmh) AS magnitude, confidence,
  CASE WHEN delta_kmh > 0 THEN constructor_b ELSE constructor_a END AS subject, 'corner:' || corner_number AS locus, session_type,
  constructor_a || '|' || constructor_b AS tie FROM attribution WHERE abs(delta_kmh) <= 18""",
    "sig_straight": """
SELECT year, round, 'straight_delta', 'straight', fastest - kmh, 1.0::DOUBLE, constructor, 'straight:' || zone, session_type, ''
FROM (SELECT *, max(kmh) OVER z AS fastest, count(*) OVER z AS n FROM (SELECT year, round, session_type, zone, constructor, avg(max_speed_kmh) AS kmh FROM zone_speed GROUP BY ALL)
      WINDOW z AS (PARTITION BY year, round, session_type, zone))
WHERE n >= 2 AND fastest >= 300 AND fastest - kmh > 0 AND fastest - kmh <= 20""",
    "sig_pace": """
SELECT year, round, CASE session_type WHEN 'R' THEN 'race_pace' ELSE 'sprint_pace' END, 'pace', gap_s, 1.0::DOUBLE, constructor, NULL, session_type, ''
FROM team_pace WHERE session_type IN ('R', 'SPRINT') AND gap_s > 0""",
    "sig_clean": """
SELECT year, round, CASE session_type WHEN 'R' THEN 'race_clean_air_pace' ELSE 'sprint_clean_air_pace' END, 'clean_air_pace', abs(gap_s - clean_gap_s), 1.0::DOUBLE, constructor, NULL, session_type, ''
FROM (SELECT *, row_number() OVER (PARTITION BY year, round, session_type ORDER BY gap_s, constructor) AS mr,
        row_number() OVER (PARTITION BY year, round, session_type ORDER BY clean_gap_s, constructor) AS cr, count(*) OVER (PARTITION BY year, round, session_type) AS n
      FROM team_clean_air JOIN team_pace USING (year, round, session_type, constructor) WHERE clean_laps >= 5 AND session_type IN ('R', 'SPRINT'))
WHERE n >= 2 AND abs(mr - cr) >= 2""",
    "sig_swing": """
SELECT r.year, r.round, 'position_swing', 'result', abs(q.position - r.position)::DOUBLE, 1.0::DOUBLE, r.constructor, NULL, 'R', r.driver::VARCHAR
FROM results r JOIN results q ON r.year = q.year AND r.round = q.round AND r.driver = q.driver
WHERE r.session_type = 'R' AND q.session_type = 'Q' AND abs(q.position - r.position) >= 2""",
    "sig_sector": """
SELECT year, round, 'sector_delta', 'sector', best - f, 1.0::DOUBLE, constructor, 'sector:' || sector, 'practice', ''
FROM (SELECT *, min(best) OVER w AS f, count(*) OVER w AS n FROM (SELECT year, round, sector, constructor, min(best_time_s) AS best FROM sector_best
        WHERE session_type IN ('FP1', 'FP2', 'FP3') GROUP BY ALL) WINDOW w AS (PARTITION BY year, round, sector)) WHERE n >= 2 AND best - f > 0""",
    "sig_top": """
SELECT year, round, 'quali_top_speed_delta', 'quali_character', m - top_speed_kmh, 1.0::DOUBLE, constructor, NULL, session_type, ''
FROM (SELECT *, max(top_speed_kmh) OVER w AS m, count(*) OVER w AS n FROM quali_rep WHERE session_type = 'Q' WINDOW w AS (PARTITION BY year, round)) WHERE n >= 2 AND m - top_speed_kmh > 0""",
    "sig_grip": """
SELECT year, round, 'quali_grip_delta', 'quali_character', m - min_speed_kmh, 1.0::DOUBLE, constructor, NULL, session_type, ''
FROM (SELECT *, max(min_speed_kmh) OVER w AS m, count(*) OVER w AS n FROM quali_rep WHERE session_type = 'Q' WINDOW w AS (PARTITION BY year, round)) WHERE n >= 2 AND m - min_speed_kmh > 0""",
    "sig_progress": """
SELECT year, round, 'quali_progression', 'quali_character', abs(d - f), 0.8::DOUBLE, constructor, NULL, session_type, ''
FROM (SELECT *, avg(d) OVER w AS f, count(*) OVER w AS n FROM (
   SELECT *, q1_time_s - coalesce(q3_time_s, q2_time_s) AS d FROM results
   WHERE session_type = 'Q' AND q1_time_s IS NOT NULL AND coalesce(q3_time_s, q2_time_s) IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY year, round, constructor ORDER BY coalesce(q3_time_s, q2_time_s), driver) = 1)
   WINDOW w AS (PARTITION BY year, round)) WHERE n >= 3 AND abs(d - f) >= 0.05""",
    "sig_residual": """
SELECT year, round, 'quali_pace_speed_residual', 'quali_character', abs(lap_time_s - (sl * top_speed_kmh + ic)), 0.75::DOUBLE, constructor, NULL, session_type, ''
FROM quali_rep JOIN (SELECT year, round, session_type, regr_slope(lap_time_s, top_speed_kmh) AS sl, regr_intercept(lap_time_s, top_speed_kmh) AS ic, count(*) AS n
  FROM quali_rep WHERE session_type = 'Q' GROUP BY ALL) USING (year, round, session_type) WHERE n >= 4 AND abs(lap_time_s - (sl * top_speed_kmh + ic)) >= 0.05""",
    "sig_ers": """
SELECT year, round, 'ers_deployment_character', 'deployment', abs(slope - f), 0.7::DOUBLE, constructor, NULL, 'R', ''
FROM (SELECT *, avg(slope) OVER w AS f, count(*) OVER w AS n FROM band_fits WINDOW w AS (PARTITION BY year, round)) WHERE n >= 3 AND abs(slope - f) >= 0.01""",
    "sig_wear": """
SELECT year, round, CASE session_type WHEN 'R' THEN 'tyre_degradation' ELSE 'sprint_degradation' END, 'degradation', cost_s, 1.0::DOUBLE, constructor, 'compound:' || compound, session_type, ''
FROM wear WHERE session_type IN ('R', 'SPRINT') AND slope_s_per_lap > 0""",
    "sig_sprint": """
SELECT a.year, a.round, 'sprint_race_pace_delta', 'cross_event', abs(a.gap_s - b.gap_s), 1.0::DOUBLE, constructor, NULL, NULL, ''
FROM (SELECT * FROM team_pace WHERE session_type = 'SPRINT') a JOIN (SELECT * FROM team_pace WHERE session_type = 'R') b USING (year, round, constructor)
WHERE a.gap_s - b.gap_s <> 0""",
    "sig": """
SELECT * FROM sig_corner UNION ALL SELECT * FROM sig_straight UNION ALL SELECT * FROM sig_pace UNION ALL SELECT * FROM sig_clean
UNION ALL SELECT * FROM sig_swing UNION ALL SELECT * FROM sig_sector UNION ALL SELECT * FROM sig_top UNION ALL SELECT * FROM sig_grip
UNION ALL SELECT * FROM sig_progress UNION ALL SELECT * FROM sig_residual UNION ALL SELECT * FROM sig_ers UNION ALL SELECT * FROM sig_wear
UNION ALL SELECT * FROM sig_sprint""",
    "actual": """
SELECT year, round, constructor, CAST(row_number() OVER (PARTITION BY year, round ORDER BY p, constructor) AS INT) AS actual_rank, p AS best_position
FROM (SELECT year, round, constructor, min(position) AS p FROM results WHERE session_type = 'R' GROUP BY ALL)""",
    "factors": """
SELECT a.year, a.round, constructor, overall_rank AS expected_rank, actual_rank,
  CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * least(CAST(1 AS DOUBLE), abs(overall_rank - actual_rank) / greatest(n - 1, 1)) AS factor
FROM (SELECT *, count(*) OVER (PARTITION BY year, round) AS n FROM actual) a JOIN snapshot s USING (year, constructor) WHERE overall_rank IS NOT NULL""",
    "scored": """
SELECT s.*, CASE WHEN peak > 0 THEN abs(magnitude) / peak ELSE 0 END * confidence * CASE WHEN category = 'result' THEN 0.5 ELSE 1 END * coalesce(factor, 1) AS robustness
FROM (SELECT *, max(abs(magnitude)) OVER (PARTITION BY year, round, signal_type) AS peak FROM sig) s
LEFT JOIN factors f ON s.year = f.year AND s.round = f.round AND s.subject = f.constructor""",
    "best_channel": """
SELECT *, count(*) OVER (PARTITION BY year, round, subject) AS channels, row_number() OVER (PARTITION BY year, round, subject
   ORDER BY -round(robustness, 9), category, signal_type, coalesce(locus, ''), coalesce(session_type, ''), tie) AS main
FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY year, round, subject, category
   ORDER BY -round(robustness, 9), category, signal_type, coalesce(locus, ''), coalesce(session_type, ''), tie) = 1)""",
    "fused": """
SELECT year, round, subject, 'cross_session' AS signal_type, 'cross_session' AS category, max(magnitude) FILTER (WHERE main = 1) AS magnitude,
  avg(confidence) AS confidence, max(locus) FILTER (WHERE main = 1) AS locus, CAST(NULL AS VARCHAR) AS session_type, '' AS tie, sum(robustness) AS robustness, count(*) AS n_refs
FROM best_channel WHERE channels >= 2 GROUP BY year, round, subject
UNION ALL SELECT year, round, subject, signal_type, category, magnitude, confidence, locus, session_type, tie, robustness, 1
FROM scored WHERE (year, round, subject) NOT IN (SELECT (year, round, subject) FROM best_channel WHERE channels >= 2)""",
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY -round(robustness, 9), subject, category, signal_type, coalesce(locus, ''),
  coalesce(session_type, ''), tie) AS rank FROM fused""",
    "note_rows": """
SELECT r.year, r.round, driver, constructor, round(p.gap_s + 1e-9, 3) AS gap_s, position, CAST(laps AS INT) AS laps,
  printf('%d-%d-%d', r.year, r.round, driver) AS doc_id
FROM results r JOIN team_pace p USING (year, round, session_type, constructor) WHERE session_type = 'R'""",
    "notes": """
SELECT year, round, doc_id, driver, CASE WHEN driver % 4 = 0 THEN printf('%s by %.3f seconds', constructor, gap_s) ELSE constructor END AS header,
  CASE WHEN driver % 20 = 1 THEN printf('%s was %.3f seconds off in qualifying through sector 2.', constructor, gap_s)
    WHEN driver % 40 = 39 THEN printf('%s finished %.3f seconds behind the winner.', constructor, gap_s)
    WHEN driver % 10 = 0 THEN printf('%s ran %.3f seconds off the pace in the race after just %d laps.', constructor, gap_s, laps)
    WHEN driver % 10 = 1 THEN printf('%s ran %.3f seconds off the pace in the race.', constructor, gap_s)
    WHEN driver % 10 = 2 THEN printf('%s retired on lap %d when it pulled off.', constructor, laps)
    WHEN driver % 10 = 3 THEN printf('A collision for %s on lap %d was noted.', constructor, laps)
    WHEN driver % 10 = 4 THEN printf('%s was %d km/h slower and its retirement traces to an incident.', constructor, driver % 60 + 31)
    WHEN driver % 10 = 5 THEN printf('%s''s %s started from the front row and led throughout.', constructor, constructor)
    WHEN driver % 10 = 6 THEN printf('%s overtook rivals on lap %d in Q with the lowest clip of the field at %d m.', constructor, laps, driver % 50 + 300)
    WHEN driver % 20 = 7 THEN printf('%s clip lengths were %d m and %d metres before the braking zone.', constructor, driver % 40 + 280, driver % 40 + 100)
    WHEN driver % 10 = 7 THEN printf('%s clip lengths were %d m and %d metres before the braking zone.', constructor, driver % 7 + 300, driver % 90 + 340)
    WHEN driver % 10 = 8 THEN printf('%s was the slowest in qualifying with a straight-line deficit.', constructor)
    ELSE printf('%s had the highest top speed in qualifying and in the race.', constructor) END AS text
FROM note_rows""",
    "evidence": """
SELECT doc_id, 'get_constructor_ranking' AS tool, printf('{"constructor":"%s","race_pace_gap_s":%.3f}', constructor, gap_s + CASE WHEN driver % 7 = 0 THEN 0.5 ELSE 0 END) AS item FROM note_rows WHERE driver % 20 <> 10
UNION ALL SELECT doc_id, 'get_session_results', printf('{"position":%d,"gap_to_leader_s":%.3f}', position, gap_s) FROM note_rows WHERE driver % 20 = 10
UNION ALL SELECT doc_id, 'get_race_control_events', printf('{"kind":"%s","lap":%d}', CASE WHEN driver % 3 = 0 THEN 'collision' ELSE 'incident' END, laps) FROM note_rows
UNION ALL SELECT doc_id, 'get_deployment', printf('{"driver":"%d","total_clip_m":%d,"max_clip_m":%d}', driver, driver % 40 + 280, driver % 40 + 100) FROM note_rows WHERE driver % 10 > 5
UNION ALL SELECT doc_id, 'get_deployment', printf('{"driver":"X","total_clip_m":320,"max_clip_m":%d}', driver % 7 + 110) FROM note_rows WHERE driver % 10 > 5
UNION ALL SELECT doc_id, 'get_candidate_insights', printf('{"category":"sector","source_refs":{"subject":"%s","refs":[{"type":"sector_delta","deficit_s":%.3f,"session_type":"practice"}]}}', constructor, gap_s) FROM note_rows WHERE driver % 20 = 1""",
    "texts": "SELECT doc_id, text FROM notes UNION ALL SELECT doc_id::VARCHAR, text FROM documents",
    "quantities": """
SELECT doc_id, CAST(i AS INT) AS nth, CAST(q[i] AS DOUBLE) AS value FROM (SELECT doc_id, regexp_extract_all(text, '(?:^|[^0-9])([-+]?\\d+(?:\\.\\d+)?)\\s*(?:km/h|kph|seconds|second|\\bsec\\b|\\bs\\b|%|metres?|meters?|m/s²|m/s2)', 1, 'i') AS q FROM texts),
  LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i)""",
    "numbers": """
SELECT doc_id, tool, round_even(CAST(unnest(regexp_extract_all(regexp_replace(item, '"[^"]*"', '""', 'g'), '[-+]?(?:\\d+\\.\\d+|\\d+)(?:[eE][-+]?\\d+)?')) AS DOUBLE), 3) AS value FROM evidence""",
}


# --- smoothing, written as the weighted sums that the recurrence amounts to --------------------

ALPHA = "(CAST(0.1 AS DOUBLE) / (1 / (2 * pi() * CAST(1.5 AS DOUBLE)) + CAST(0.1 AS DOUBLE)))"


def smoothed(source: str, value: str) -> str:
    """(lap_id, sample_idx, v): the low-pass of 64 evenly timed samples, forward then backward."""
    forward = f"""SELECT a.lap_id, a.sample_idx, sum(b.{value} * CASE WHEN b.sample_idx = 1 THEN pow(1 - {ALPHA}, a.sample_idx - 1)
        ELSE {ALPHA} * pow(1 - {ALPHA}, a.sample_idx - b.sample_idx) END) AS f
      FROM {source} a JOIN {source} b ON a.lap_id = b.lap_id AND b.sample_idx <= a.sample_idx GROUP BY ALL"""
    return f"""WITH fw AS MATERIALIZED ({forward}) SELECT a.lap_id, a.sample_idx, sum(b.f * CASE WHEN b.sample_idx = 64 THEN pow(1 - {ALPHA}, 64 - a.sample_idx)
        ELSE {ALPHA} * pow(1 - {ALPHA}, b.sample_idx - a.sample_idx) END) AS v
      FROM fw a JOIN fw b ON a.lap_id = b.lap_id AND b.sample_idx >= a.sample_idx GROUP BY ALL"""


def derived(source: str) -> str:
    """(lap_id, sample_idx, v): derivative on an even 0.1 s clock."""
    return f"""SELECT lap_id, sample_idx, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v))
        / CASE WHEN sample_idx IN (1, 64) THEN 0.1 ELSE 0.2 END AS v FROM {source} WINDOW w AS (PARTITION BY lap_id ORDER BY sample_idx)"""


CTES.update(
    {
        "smooth_kmh": smoothed("tel", "speed_kmh"),
        "raw_accel": derived("(SELECT lap_id, sample_idx, v / CAST(3.6 AS DOUBLE) AS v FROM smooth_kmh)"),
        "smooth_accel": smoothed("raw_accel", "v"),
        "positions": """SELECT lap_id, sample_idx, (sample_idx - 1) * CAST(6.4 AS DOUBLE) AS px,
          CAST(0.5 AS DOUBLE) * CAST(embedding[sample_idx] AS DOUBLE) AS py FROM tel""",
        "smooth_x": smoothed("positions", "px"),
        "smooth_y": smoothed("positions", "py"),
        "x_speed": derived("smooth_x"),
        "y_speed": derived("smooth_y"),
        "x_turn": derived("x_speed"),
        "y_turn": derived("y_speed"),
        "side_accel": """SELECT lap_id, sample_idx, abs(a.v * d.v - b.v * c.v) / pow(greatest(a.v * a.v + b.v * b.v, 1e-6), 1.5) * (a.v * a.v + b.v * b.v) AS v
          FROM x_speed a JOIN y_speed b USING (lap_id, sample_idx) JOIN x_turn c USING (lap_id, sample_idx) JOIN y_turn d USING (lap_id, sample_idx)""",
    }
)

CTES["clip_points"] = """
SELECT *, sum(turned) OVER (PARTITION BY lap_id ORDER BY sample_idx) AS island FROM (
  SELECT *, CASE WHEN wot IS NOT DISTINCT FROM lag(wot) OVER w THEN 0 ELSE 1 END AS turned, lead(brake) OVER w AS next_brake
  FROM (SELECT t.*, s.v AS s, a.v AS acc, throttle >= 98 AND NOT brake AS wot FROM tel t JOIN smooth_kmh s USING (lap_id, sample_idx)
        JOIN smooth_accel a USING (lap_id, sample_idx) WHERE lap_id IN (SELECT lap_id FROM fast_rep)) WINDOW w AS (PARTITION BY lap_id ORDER BY sample_idx))"""
CTES["clip_runs"] = """
SELECT *, max(top) OVER (PARTITION BY lap_id) AS lap_top FROM (
  SELECT lap_id, island, min(distance_m) AS start_m, max(distance_m) AS end_m, max(speed_kmh) AS top, max(s) AS peak, arg_min(sample_idx, (-s, sample_idx)) AS pk,
    arg_max(s, sample_idx) AS end_s, coalesce(arg_max_null(next_brake, sample_idx), false) AS braked FROM clip_points WHERE wot GROUP BY ALL
  HAVING max(distance_m) - min(distance_m) >= 250 OR max(speed_kmh) >= 250)"""
CTES["clip_fit"] = """
SELECT lap_id, island, regr_slope(acc, pow(s / CAST(3.6 AS DOUBLE), 2)) AS sl, regr_intercept(acc, pow(s / CAST(3.6 AS DOUBLE), 2)) AS ic, count(*) AS n_rising
FROM (SELECT *, lag(s) OVER (PARTITION BY lap_id, island ORDER BY sample_idx) AS ps FROM clip_points WHERE wot) WHERE s > ps AND s >= 200 GROUP BY ALL"""
CTES["clip_judged"] = """
SELECT *, CASE WHEN NOT live THEN 'deploy' WHEN ddr THEN CASE WHEN res > -2 THEN 'deploy' WHEN res > -6.5 THEN 'depletion' ELSE 'superclip' END
   ELSE CASE WHEN res >= -2 THEN 'deploy' WHEN res >= -6 THEN 'depletion' ELSE 'superclip' END END AS state
FROM (SELECT *, CASE WHEN NOT live THEN 0 WHEN ddr THEN greatest(-15, least(15, acc - (ic + sl * pow(s / CAST(3.6 AS DOUBLE), 2)))) ELSE acc END AS res
  FROM (SELECT p.*, r.* EXCLUDE (lap_id, island), sl, ic, coalesce(n_rising >= 6 AND sl < 0, false) AS ddr, s >= 280 AND sample_idx > pk AND s <= peak - 3 AS live
        FROM clip_points p JOIN clip_runs r USING (lap_id, island) LEFT JOIN clip_fit f USING (lap_id, island) WHERE p.wot))"""
CTES["clip_kept"] = """
SELECT *, lead(distance_m) OVER (PARTITION BY lap_id, island, run ORDER BY sample_idx) - distance_m AS seg FROM (
  SELECT *, CASE WHEN state <> 'deploy' AND count(*) OVER (PARTITION BY lap_id, island, run) < 3 THEN 'deploy' ELSE state END AS kept
  FROM (SELECT *, sum(flip) OVER (PARTITION BY lap_id, island ORDER BY sample_idx) AS run FROM (
    SELECT *, CASE WHEN (state <> 'deploy') IS NOT DISTINCT FROM (lag(state) OVER (PARTITION BY lap_id, island ORDER BY sample_idx) <> 'deploy') THEN 0 ELSE 1 END AS flip
    FROM clip_judged)))"""
CTES["clip"] = """
SELECT *, depletion_m + superclip_m AS clip_m, peak_kmh >= CAST(0.85 AS DOUBLE) * lap_top AND depletion_m + superclip_m >= 40 AS is_clip,
  CASE WHEN depletion_m > 0 AND superclip_m > 0 THEN 'mixed' WHEN depletion_m > 0 THEN 'depletion' WHEN superclip_m > 0 THEN 'superclip' ELSE '' END AS clip_type
FROM (SELECT lap_id, year, round, session_type, driver, constructor, island, any_value(start_m) AS start_m, any_value(end_m) AS end_m, any_value(peak) AS peak_kmh,
   max(distance_m) FILTER (WHERE sample_idx = pk) AS peak_at_m, any_value(peak) - any_value(end_s) AS drop_kmh, any_value(lap_top) AS lap_top,
   CASE WHEN any_value(braked) THEN 'brake' ELSE 'lift' END AS end_reason, CASE WHEN any_value(ddr) THEN 'ddr' ELSE 'ssdg' END AS method,
   coalesce(sum(seg) FILTER (WHERE kept = 'depletion'), 0) AS depletion_m, coalesce(sum(seg) FILTER (WHERE kept = 'superclip'), 0) AS superclip_m,
   min(res) FILTER (WHERE kept <> 'deploy') AS worst FROM clip_kept GROUP BY ALL)"""
CTES["clip_total"] = """
SELECT year, round, session_type, driver, constructor, lap_id, count(*) AS n_straights, count(*) FILTER (WHERE is_clip) AS n_clips,
  round_even(coalesce(sum(clip_m) FILTER (WHERE is_clip), 0), 1) AS total_clip_m, round_even(coalesce(sum(depletion_m) FILTER (WHERE is_clip), 0), 1) AS total_depletion_m,
  round_even(coalesce(sum(superclip_m) FILTER (WHERE is_clip), 0), 1) AS total_superclip_m, round_even(coalesce(max(clip_m) FILTER (WHERE is_clip), 0), 1) AS max_clip_m,
  round_even(coalesce(min(worst) FILTER (WHERE is_clip), 0), 2) AS max_clip_severity_ms2, round_even(max(peak_kmh), 1) AS top_speed_kmh FROM clip GROUP BY ALL"""

# --- smoothed race accelerations and deployment clips --------------------------------------

CTES["accel_pts"] = """
SELECT t.*, a.v AS accel_ms2 FROM tel t JOIN smooth_accel a USING (lap_id, sample_idx) JOIN side_accel l USING (lap_id, sample_idx)
WHERE throttle >= 98 AND NOT brake AND abs(l.v) < 2 AND abs(a.v) <= 20 AND lap_id IN (
  SELECT lap_id FROM tlap WHERE session_type = 'R' AND is_representative
  QUALIFY row_number() OVER (PARTITION BY year, round, session_type, driver ORDER BY lap_time_s, lap_id) <= 5)"""
CTES["sig_clip"] = """
SELECT year, round, 'deployment_clip', 'deployment', m - b, 1.0::DOUBLE, constructor, NULL, session_type, ''
FROM (SELECT *, min(m) OVER w AS b, count(*) OVER w AS kept FROM (
   SELECT *, count(*) OVER (PARTITION BY year, round, session_type) AS teams FROM (
     SELECT year, round, session_type, constructor, count(*) FILTER (WHERE max_clip_m > 0) AS cars, min(total_clip_m) FILTER (WHERE max_clip_m > 0) AS m
     FROM clip_total WHERE session_type = 'Q' GROUP BY ALL)) WHERE teams >= 2 AND cars >= 2
   WINDOW w AS (PARTITION BY year, round, session_type)) WHERE kept >= 2 AND m - b > 100"""
CTES["sig"] += " UNION ALL SELECT * FROM sig_clip"
