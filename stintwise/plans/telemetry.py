"""Telemetry, corner and straight queries."""

from pyspark.sql import functions as F

from stintwise.constants import SESSION_KEYS, WEEKEND_KEYS
from stintwise.functions.kernels import lateral_accel, longitudinal_accel, lowpass
from stintwise.operators import corners as K
from stintwise.operators import telemetry as T
from stintwise.plans.columns import rounded
from stintwise.plans.registry import ORACLES, query
from stintwise.sources.landing import CORNERS

GK = "year, round, session_type"
LAP_SQL = "year, round, session_type, driver, constructor, lap_id"
TEAM_A, TEAM_B = "NATION_1", "NATION_3"


@query(
    "landing_telemetry",
    f"""SELECT {LAP_SQL}, sample_idx, round(distance_m, 6) AS distance_m, round(speed_kmh, 6) AS speed_kmh, throttle, brake,
    round(time_s, 6) AS time_s FROM tel""",
)
def _(t):
    long = T.samples(t.telemetry, T.LAP, "distance_m", "speed_kmh", "throttle", "brake", "time_s")
    return rounded(long)


@query(
    "corner_min_speed",
    f"SELECT {LAP_SQL}, corner_number, round(min_speed_kmh, 6) AS min_speed_kmh FROM corner_speed",
)
def _(t):
    laps = t.telemetry.select(*T.LAP, "distance_m", "speed_kmh")
    return rounded(K.corner_min_speeds(laps, CORNERS))


@query(
    "zone_speeds",
    f"""SELECT {LAP_SQL}, CAST(zone AS INT) AS zone, round(max_speed_kmh, 6) AS max_speed_kmh,
    round(trap_speed_kmh, 6) AS trap_speed_kmh FROM zone_speed""",
)
def _(t):
    return rounded(K.zone_speeds(K.fastest(t.telemetry, "is_clean"), CORNERS))


@query(
    "corner_prints",
    f"""SELECT {GK}, driver, constructor, corner_number, compound, round(min_speed_kmh, 6) AS min_speed_kmh, clean_laps
    FROM prints""",
)
def _(t):
    return rounded(K.corner_prints(t.telemetry, CORNERS))


@query(
    "lap_character",
    f"""SELECT {LAP_SQL}, round(lap_time_s, 6) AS lap_time_s, round(top_speed_kmh, 6) AS top_speed_kmh,
    round(min_speed_kmh, 6) AS min_speed_kmh, round(full_throttle_share, 6) AS full_throttle_share FROM quali_row""",
)
def _(t):
    return rounded(K.lap_character(t.telemetry))


@query(
    "valid_throttle",
    """SELECT lap_id, round(coalesce(avg(CASE WHEN throttle <= 100 THEN CASE WHEN throttle >= 99 THEN 1.0 ELSE 0.0 END END), 0)::DOUBLE, 6)
    AS full_throttle_share FROM tel GROUP BY ALL""",
)
def _(t):
    share = K.full_throttle_share(F.col("throttle")).alias("full_throttle_share")
    return rounded(t.telemetry.select("lap_id", share))


@query(
    "corner_speed_map",
    f"""SELECT {LAP_SQL}, string_agg(corner_number || '=' || printf('%.3f', min_speed_kmh), ';' ORDER BY corner_number) AS corner_speeds
    FROM corner_speed WHERE lap_id IN (SELECT lap_id FROM fast_rep) GROUP BY ALL""",
)
def _(t):
    speeds = K.corner_speed_map(K.lap_corner_speeds(t.telemetry, CORNERS))
    text = F.array_join(
        F.transform(
            F.map_entries("corner_speeds"),
            lambda e: F.format_string("%d=%.3f", e["key"], e["value"]),
        ),
        ";",
    )
    return speeds.select(*T.LAP, text.alias("corner_speeds"))


PAIR_SQL = f"""SELECT {GK}, corner_number, constructor_a, constructor_b, round(delta_kmh, 6) AS delta_kmh, speed_class,
round(car_pct, 6) AS car_pct, round(driver_pct, 6) AS driver_pct, round(confidence, 6) AS confidence FROM attribution"""


@query("corner_attribution", PAIR_SQL)
def _(t):
    return rounded(K.attribution(t.prints))


@query(
    "constructor_pairs",
    f"""SELECT {GK}, corner_number, a.constructor AS constructor_a, b.constructor AS constructor_b
    FROM team_corner a JOIN team_corner b USING ({GK}, corner_number) WHERE a.constructor < b.constructor""",
)
def _(t):
    return t.pairs.select(*K.CORNER_KEYS, "constructor_a", "constructor_b")


@query(
    "speed_class",
    """SELECT lap_id, corner_number, CASE WHEN min_speed_kmh < 125 THEN 'low' WHEN min_speed_kmh < 200 THEN 'mid' ELSE 'high' END
    AS speed_class FROM corner_speed""",
)
def _(t):
    from stintwise.functions.expressions import speed_class

    laps = t.telemetry.select("lap_id", "distance_m", "speed_kmh")
    speeds = K.corner_min_speeds(laps, CORNERS)
    return speeds.select(
        "lap_id", "corner_number", speed_class(F.col("min_speed_kmh")).alias("speed_class")
    )


INDEX_SQL = """WITH adv AS (SELECT year, round, constructor, car_kmh - f AS v, least(CAST(1 AS DOUBLE), min_laps / 8) AS w,
   CASE WHEN f < 125 THEN 'low' WHEN f < 200 THEN 'mid' ELSE 'high' END AS cls
 FROM (SELECT *, avg(car_kmh) OVER p AS f, count(*) OVER p AS n FROM team_corner
       WINDOW p AS (PARTITION BY year, round, session_type, corner_number)) WHERE n >= 2),
 s AS (SELECT year, round, constructor,
   sum(v * w) FILTER (WHERE cls = 'high') / nullif(sum(w) FILTER (WHERE cls = 'high'), 0) AS high_score,
   sum(v * w) FILTER (WHERE cls = 'mid') / nullif(sum(w) FILTER (WHERE cls = 'mid'), 0) AS mid_score,
   sum(v * w) FILTER (WHERE cls = 'low') / nullif(sum(w) FILTER (WHERE cls = 'low'), 0) AS low_score,
   sum(v * w) / nullif(sum(w), 0) AS overall_score FROM adv GROUP BY ALL),
 idx AS (SELECT *, CAST(row_number() OVER (PARTITION BY year, round ORDER BY lap_deficit_s NULLS LAST, constructor) AS INT) AS overall_rank
   FROM s FULL JOIN (SELECT year, round, constructor, gap_s AS lap_deficit_s FROM race_team_pace) USING (year, round, constructor))"""


@query(
    "constructor_index",
    f"""{INDEX_SQL} SELECT year, round, constructor, round(high_score, 6) AS high_score, round(mid_score, 6) AS mid_score,
    round(low_score, 6) AS low_score, round(overall_score, 6) AS overall_score, round(lap_deficit_s, 6) AS lap_deficit_s, overall_rank FROM idx""",
)
def _(t):
    return rounded(K.constructor_index(t.prints, t.race_pace))


@query(
    "quality_report",
    """WITH c AS (SELECT year, round, constructor, corner_number, CAST(sum(clean_laps) AS BIGINT) AS clean_laps FROM prints GROUP BY ALL),
    conf AS (SELECT year, round, k AS constructor, avg(confidence) AS m FROM (
       SELECT year, round, constructor_a AS k, confidence FROM attribution UNION ALL
       SELECT year, round, constructor_b, confidence FROM attribution) GROUP BY ALL)
    SELECT year, round, constructor, corner_number, clean_laps, CAST(NULL AS BIGINT) AS corners, CAST(NULL AS DOUBLE) AS mean_confidence FROM c
    UNION ALL SELECT year, round, constructor, NULL, CAST(sum(clean_laps) AS BIGINT), count(*), round(any_value(m), 6)
    FROM c LEFT JOIN conf USING (year, round, constructor) GROUP BY year, round, constructor""",
)
def _(t):
    return rounded(K.quality_report(t.prints, t.pairs))


LOOKUP_SQL = f"""SELECT {GK}, corner_number, speed_class, round(CASE WHEN constructor_a = '{TEAM_B}' THEN delta_kmh ELSE -delta_kmh END, 6) AS delta_kmh,
round(car_pct, 6) AS car_pct, round(driver_pct, 6) AS driver_pct, round(confidence, 6) AS confidence FROM attribution
WHERE constructor_a IN ('{TEAM_A}', '{TEAM_B}') AND constructor_b IN ('{TEAM_A}', '{TEAM_B}')"""


@query("corner_delta_lookup", LOOKUP_SQL)
def _(t):
    return rounded(K.corner_delta_lookup(t.pairs, TEAM_B, TEAM_A))


@query(
    "straight_lookup",
    f"""SELECT {GK}, driver, CAST(zone AS INT) AS zone, round(max_speed_kmh, 6) AS max_speed_kmh, round(max_speed_kmh * 0.621371, 6) AS max_speed_mph,
    round(trap_speed_kmh, 6) AS trap_speed_kmh FROM zone_speed WHERE driver = 3 AND zone = 0 AND session_type = 'Q'""",
)
def _(t):
    from stintwise.functions.expressions import mph

    rows = t.zones.where(
        (F.col("driver") == 3) & (F.col("zone") == 0) & (F.col("session_type") == "Q")
    )
    return rounded(
        rows.select(
            *SESSION_KEYS,
            "driver",
            "zone",
            "max_speed_kmh",
            mph(F.col("max_speed_kmh")).alias("max_speed_mph"),
            "trap_speed_kmh",
        )
    )


@query(
    "speed_profile",
    f"""WITH pr AS (SELECT *, CASE WHEN constructor_a = '{TEAM_B}' THEN delta_kmh ELSE -delta_kmh END AS d FROM attribution
      WHERE constructor_a IN ('{TEAM_A}', '{TEAM_B}') AND constructor_b IN ('{TEAM_A}', '{TEAM_B}') AND confidence >= 0.5 AND abs(delta_kmh) <= 15),
    u AS (SELECT {GK}, coalesce(speed_class, 'unclassified') AS item, 'cornering_kmh' AS channel, avg(d) AS delta,
        string_agg(corner_number::VARCHAR, ',' ORDER BY corner_number) AS corner_numbers, count(*) AS n_corners FROM pr GROUP BY ALL
      UNION ALL SELECT {GK}, 'lap', 'top_speed_kmh', max(max_speed_kmh) FILTER (WHERE constructor = '{TEAM_B}')
        - max(max_speed_kmh) FILTER (WHERE constructor = '{TEAM_A}') AS delta, '', 0 FROM zone_speed GROUP BY {GK} HAVING abs(delta) <= 20
      UNION ALL SELECT {GK}, sector::VARCHAR, 'sector_s', min(best_time_s) FILTER (WHERE constructor = '{TEAM_B}')
        - min(best_time_s) FILTER (WHERE constructor = '{TEAM_A}') AS delta, '', 0 FROM sector_best GROUP BY {GK}, sector HAVING delta IS NOT NULL)
    SELECT {GK}, item, channel, round_even(delta, 3) AS delta, coalesce(corner_numbers, '') AS corner_numbers, coalesce(n_corners, 0) AS n_corners,
      count(delta) OVER (PARTITION BY {GK}) > 0 AS confident
    FROM (SELECT DISTINCT {GK}, unnest(['cornering_kmh', 'top_speed_kmh', 'sector_s']) AS channel FROM laps) LEFT JOIN u USING ({GK}, channel)""",
)
def _(t):
    return K.speed_profile(t.sessions, t.pairs, t.zones, t.sector_bests, TEAM_B, TEAM_A)


@query(
    "corner_caps",
    f"""SELECT {GK}, corner_number, constructor_a, constructor_b, round(delta_kmh, 6) AS delta_kmh,
      coalesce(delta_kmh IS NOT NULL AND confidence IS NOT NULL AND abs(delta_kmh) <= 18, false) AS plausible, coalesce(confidence >= 0.5 AND abs(delta_kmh) <= 15, false) AS profiled
    FROM attribution""",
)
def _(t):
    return rounded(K.corner_caps(t.pairs))


@query(
    "straight_caps",
    f"""SELECT *, fastest_kmh >= 300 AND deficit_kmh > 0 AND deficit_kmh <= 20 AS plausible FROM (
      SELECT {GK}, zone, constructor, round(kmh, 6) AS kmh, round(fastest_kmh, 6) AS fastest_kmh, round(fastest_kmh - kmh, 6) AS deficit_kmh FROM (
        SELECT *, max(kmh) OVER (PARTITION BY {GK}, zone) AS fastest_kmh FROM (
          SELECT {GK}, zone, constructor, avg(max_speed_kmh) AS kmh FROM zone_speed WHERE constructor IS NOT NULL AND max_speed_kmh IS NOT NULL GROUP BY ALL)))""",
)
def _(t):
    return rounded(K.straight_caps(t.zones))


# --- sample kernels ---------------------------------------------------------

GRAD = """SELECT *, CASE WHEN hs IS NULL THEN (vn - v) / hd WHEN hd IS NULL THEN (v - vp) / hs
 ELSE (hs * hs * vn + (hd * hd - hs * hs) * v - hd * hd * vp) / (hs * hd * (hs + hd)) END AS accel_ms2
FROM (SELECT *, speed_kmh / CAST(3.6 AS DOUBLE) AS v, lag(speed_kmh) OVER w / CAST(3.6 AS DOUBLE) AS vp, lead(speed_kmh) OVER w / CAST(3.6 AS DOUBLE) AS vn,
      time_s - lag(time_s) OVER w AS hs, lead(time_s) OVER w - time_s AS hd FROM tel
      WINDOW w AS (PARTITION BY lap_id ORDER BY sample_idx))"""


def with_gradient(laps):
    metres = F.transform("speed_kmh", lambda v: v / F.lit(3.6))
    return laps.withColumn("accel_ms2", T.gradient(metres, F.col("time_s")))


@query("gradient", f"SELECT lap_id, sample_idx, round(accel_ms2, 6) AS accel_ms2 FROM ({GRAD})")
def _(t):
    return rounded(T.samples(with_gradient(t.telemetry), ["lap_id"], "accel_ms2"))


@query(
    "lap_relative_time",
    """SELECT lap_id, sample_idx, round(time_s + lap_id - first_value(time_s + lap_id) OVER (PARTITION BY lap_id ORDER BY sample_idx), 6) AS time_s FROM tel""",
)
def _(t):
    clock = F.transform("time_s", lambda s: s + F.col("lap_id"))
    shifted = t.telemetry.withColumn("time_s", clock)
    return rounded(
        T.samples(
            shifted.withColumn("time_s", T.lap_relative_time(F.col("time_s"))), ["lap_id"], "time_s"
        )
    )


@query(
    "time_from_distance",
    """SELECT lap_id, sample_idx, round(coalesce(sum(dt) OVER (PARTITION BY lap_id ORDER BY sample_idx
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS time_s
    FROM (SELECT *, (distance_m - lag(distance_m) OVER w) / greatest(lag(speed_kmh) OVER w / 3.6, 1) AS dt FROM tel
          WINDOW w AS (PARTITION BY lap_id ORDER BY sample_idx))""",
)
def _(t):
    return rounded(T.time_from_distance(t.telemetry))


@query(
    "full_throttle_samples",
    f"""SELECT lap_id, sample_idx, round(speed_kmh, 6) AS speed_kmh, round(accel_ms2, 6) AS accel_ms2 FROM ({GRAD})
    WHERE throttle >= 98 AND NOT brake AND abs((speed_kmh - 230) / 20) < 2 AND abs(accel_ms2) <= 20""",
)
def _(t):
    lateral = F.transform("speed_kmh", lambda v: (v - 230) / 20)
    laps = with_gradient(t.telemetry).withColumn("lateral_ms2", lateral)
    points = T.samples(
        laps, ["lap_id"], "speed_kmh", "accel_ms2", "lateral_ms2", "throttle", "brake"
    )
    return rounded(
        T.deployment_samples(points).select("lap_id", "sample_idx", "speed_kmh", "accel_ms2")
    )


ISLANDS = """SELECT *, sum(turned) OVER (PARTITION BY lap_id ORDER BY sample_idx) AS island
FROM (SELECT *, CASE WHEN wot IS NOT DISTINCT FROM lag(wot) OVER w THEN 0 ELSE 1 END AS turned, lead(brake) OVER w AS next_brake
      FROM (SELECT *, throttle >= 98 AND NOT brake AS wot FROM tel) WINDOW w AS (PARTITION BY lap_id ORDER BY sample_idx))"""


@query(
    "wot_straights",
    f"""SELECT lap_id, round(min(distance_m), 6) AS start_m, round(max(distance_m), 6) AS end_m, round(max(speed_kmh), 6) AS top_kmh, count(*) AS n_samples,
    CASE WHEN coalesce(arg_max_null(next_brake, sample_idx), false) THEN 'brake' ELSE 'lift' END AS end_reason
    FROM ({ISLANDS}) WHERE wot GROUP BY lap_id, island HAVING max(distance_m) - min(distance_m) >= 250 OR max(speed_kmh) >= 250""",
)
def _(t):
    points = T.samples(t.telemetry, ["lap_id"], "distance_m", "speed_kmh", "throttle", "brake")
    return rounded(T.wot_straights(points, ["lap_id"]).drop("island"))


STATES = f"""SELECT *, CASE WHEN accel_ms2 >= -2 THEN 'deploy' WHEN accel_ms2 >= -60 THEN 'depletion' ELSE 'superclip' END AS state FROM ({GRAD})"""
RUNS = f"""SELECT *, CASE WHEN state <> 'deploy' AND count(*) OVER (PARTITION BY lap_id, run) < 3 THEN 'deploy' ELSE state END AS kept
FROM (SELECT *, sum(turned) OVER (PARTITION BY lap_id ORDER BY sample_idx) AS run
  FROM (SELECT *, CASE WHEN (state <> 'deploy') IS NOT DISTINCT FROM (lag(state) OVER (PARTITION BY lap_id ORDER BY sample_idx) <> 'deploy') THEN 0 ELSE 1 END AS turned
        FROM ({STATES})))"""


def states(t):
    accel = F.col("accel_ms2")
    state = F.when(accel >= -2, "deploy").when(accel >= -60, "depletion").otherwise("superclip")
    points = T.samples(with_gradient(t.telemetry), ["lap_id"], "distance_m", "accel_ms2")
    return points.withColumn("state", state)


@query("state_hysteresis", f"SELECT lap_id, sample_idx, state, kept FROM ({RUNS})")
def _(t):
    return T.clip_states(states(t), ["lap_id"]).select("lap_id", "sample_idx", "state", "kept")


@query(
    "clip_lengths",
    f"""SELECT *, round(depletion_m + superclip_m, 6) AS clip_m, CASE WHEN depletion_m > 0 AND superclip_m > 0 THEN 'mixed' WHEN depletion_m > 0 THEN 'depletion'
      WHEN superclip_m > 0 THEN 'superclip' ELSE '' END AS clip_type
    FROM (SELECT lap_id, round(sum(CASE WHEN kept = 'depletion' THEN step ELSE 0 END), 6) AS depletion_m,
      round(sum(CASE WHEN kept = 'superclip' THEN step ELSE 0 END), 6) AS superclip_m
      FROM (SELECT lap_id, kept, coalesce(lead(distance_m) OVER (PARTITION BY lap_id, run ORDER BY sample_idx) - distance_m, 0) AS step FROM ({RUNS}))
      GROUP BY lap_id)""",
)
def _(t):
    return rounded(T.clip_lengths(T.clip_states(states(t), ["lap_id"]), ["lap_id"]))


@query(
    "plausible_laps",
    f"""SELECT lap_id, round(length_m, 6) AS length_m, round(typical_m, 6) AS typical_m FROM
    (SELECT *, quantile_cont(length_m, 0.5) OVER (PARTITION BY {GK}) AS typical_m FROM (SELECT *, 63 * step AS length_m FROM tlap))
    WHERE abs(length_m - typical_m) <= 100""",
)
def _(t):
    laps = t.telemetry.select(*T.LAP, "distance_m")
    return rounded(T.plausible_laps(laps).select("lap_id", "length_m", "typical_m"))


@query(
    "resample_linear",
    """SELECT lap_id, CAST(k + 1 AS INT) AS sample_idx, CAST(k * 10 AS DOUBLE) AS distance_m,
    round(230 + 300 * (embedding[i] + (embedding[least(i + 1, 64)]::DOUBLE - embedding[i]) * f), 6) AS speed_kmh
    FROM (SELECT lap_id, k, embedding::DOUBLE[] AS embedding, least(CAST(floor(k * 10 / step) AS INT), 63) + 1 AS i,
          CASE WHEN k * 10 / step >= 63 THEN 0 ELSE k * 10 / step - floor(k * 10 / step) END AS f FROM tlap, range(0, 521) r(k))""",
)
def _(t):
    at = F.transform(F.sequence(F.lit(0), F.lit(520)), lambda k: k * F.lit(10.0))
    laps = t.telemetry.select("lap_id", "distance_m", "speed_kmh")
    return rounded(T.samples(T.resampled(laps, at, "speed_kmh"), ["lap_id"], "distance_m", "speed_kmh"))


@query(
    "fraction_aligned_trace",
    f"""WITH q AS (SELECT *, 63 * step AS length_m FROM fast_rep WHERE session_type = 'Q'),
    kept_laps AS (SELECT * FROM (SELECT *, quantile_cont(length_m, 0.5) OVER (PARTITION BY {GK}) AS typical FROM q) WHERE abs(length_m - typical) <= 100),
    nom AS (SELECT {GK}, quantile_cont(length_m, 0.5) AS nominal, arg_min(lap_id, (lap_time_s, lap_id)) AS pole FROM kept_laps GROUP BY ALL),
    grid AS (SELECT {GK}, nominal, pole, unnest(range(0, CAST(ceil(nominal / 10) AS INT) + 1)) AS k FROM nom),
    pts AS (SELECT l.*, k, pole, CASE WHEN k = ceil(nominal / 10) THEN round(nominal, 1) ELSE k * CAST(10 AS DOUBLE) END AS grid_m, nominal
            FROM kept_laps l JOIN grid USING ({GK})),
    pos AS (SELECT *, least(grid_m * length_m / nominal / step, 63) AS p FROM pts),
    val AS (SELECT {LAP_SQL}, k, grid_m, lap_id = pole AS is_pole, p / 10 AS time_s,
              230 + 300 * (e[i] + (e[i + 1] - e[i]) * (p - i + 1)) AS speed_kmh,
              h(e[i]) + (h(e[i + 1]) - h(e[i])) * (p - i + 1) AS throttle
            FROM (SELECT *, embedding::DOUBLE[] AS e, least(CAST(floor(p) AS INT), 62) + 1 AS i FROM pos))
    SELECT v.* EXCLUDE (k, speed_kmh, throttle, time_s), CAST(v.k + 1 AS INT) AS sample_idx, round(v.speed_kmh, 6) AS speed_kmh, round(v.throttle, 6) AS throttle,
      round(v.time_s - b.time_s, 6) AS delta_s FROM val v JOIN val b USING ({GK}, k) WHERE b.is_pole""".replace(
        "h(e[i + 1])", "CASE WHEN e[i + 1] > -0.1 THEN 100.0 ELSE 50.0 END::DOUBLE"
    ).replace("h(e[i])", "CASE WHEN e[i] > -0.1 THEN 100.0 ELSE 50.0 END::DOUBLE"),
)
def _(t):
    traces = T.aligned_traces(t.telemetry.where(F.col("session_type") == "Q"))
    return rounded(
        T.samples(traces, [*T.LAP, "is_pole"], "grid_m", "speed_kmh", "throttle", "delta_s")
    )


@query(
    "trace_page",
    f"""SELECT {LAP_SQL}, is_pole, round(any_value(lap_time_s), 6) AS lap_time_s, count(*) AS n_points, round(max(grid_m), 6) AS grid_end_m, round(arg_max(delta_s, sample_idx), 6) AS lost_s,
      row_number() OVER (PARTITION BY {GK} ORDER BY any_value(lap_time_s), lap_id) AS place
    FROM ({ORACLES["fraction_aligned_trace"]}) JOIN (SELECT lap_id, lap_time_s FROM fast_rep) USING (lap_id) GROUP BY {LAP_SQL}, is_pole""",
)
def _(t):
    """The fight to pole: the main qualifying session's drivers, the fastest first."""
    return rounded(T.trace_page(T.aligned_traces(t.telemetry.where(F.col("session_type") == "Q"))))


@query(
    "trace_vs_pole",
    f"""WITH f AS (SELECT * FROM tel WHERE lap_id IN (SELECT lap_id FROM fast_rep)),
    pole AS (SELECT {GK}, arg_min(lap_id, (lap_time_s, lap_id)) AS pole FROM fast_rep GROUP BY ALL)
    SELECT lap_id, sample_idx, round(speed_kmh - max(CASE WHEN lap_id = pole THEN speed_kmh END) OVER (PARTITION BY {GK}, sample_idx), 6) AS delta_kmh
    FROM f JOIN pole USING ({GK})""",
)
def _(t):
    laps = K.fastest(t.telemetry, "is_representative").select(*T.LAP, "lap_time_s", "speed_kmh")
    pole = laps.groupBy(*SESSION_KEYS).agg(
        F.min_by("speed_kmh", F.struct("lap_time_s", "lap_id")).alias("_pole")
    )
    delta = F.zip_with("speed_kmh", "_pole", lambda a, b: a - b)
    joined = laps.join(pole, SESSION_KEYS).withColumn("delta_kmh", delta)
    return rounded(T.samples(joined, ["lap_id"], "delta_kmh"))


TRACES = """SELECT lap_id, corner_number, j, lo + j * 150 / CAST(49 AS DOUBLE) AS g, lo,
  e[i] + (e[i + 1] - e[i]) * f AS s, h0 + (h1 - h0) * f AS th, b0 + (b1 - b0) * f AS br, g0 + (g1 - g0) * f AS gear
 FROM (SELECT *, CASE WHEN e0[i] > -0.1 THEN 100.0 ELSE 50.0 END::DOUBLE AS h0, CASE WHEN e0[i + 1] > -0.1 THEN 100.0 ELSE 50.0 END::DOUBLE AS h1,
   CASE WHEN e0[i] < -0.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS b0, CASE WHEN e0[i + 1] < -0.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS b1,
   floor(e[i] / 50) AS g0, floor(e[i + 1] / 50) AS g1
  FROM (SELECT lap_id, corner_number, j, at_m - 75 AS lo, embedding::DOUBLE[] AS e0, list_transform(embedding, lambda v: CAST(230 AS DOUBLE) + CAST(300 AS DOUBLE) * CAST(v AS DOUBLE)) AS e,
     CAST(floor((at_m - 75 + j * 150 / CAST(49 AS DOUBLE)) / step) AS INT) + 1 AS i,
     (at_m - 75 + j * 150 / CAST(49 AS DOUBLE)) / step - floor((at_m - 75 + j * 150 / CAST(49 AS DOUBLE)) / step) AS f
   FROM tlap, corners, range(0, 50) r(j)))"""


FEATURES_SQL = f"""WITH tr AS ({TRACES}),
apex AS (SELECT lap_id, corner_number, arg_min(j, (s, j)) AS ja, min(s) AS min_speed FROM tr GROUP BY ALL),
br AS (SELECT lap_id, corner_number, min(j) AS jb FROM tr WHERE br > 0.5 GROUP BY ALL),
pw AS (SELECT lap_id, corner_number, min(j) AS jp FROM tr JOIN apex USING (lap_id, corner_number) WHERE j >= ja AND th > 20 GROUP BY ALL)
SELECT lap_id, corner_number, round(min_speed, 6) AS min_speed_kmh, round(xb.g - xb.lo, 6) AS brake_point_m,
  round(CASE WHEN jb <= ja THEN xa.g - xb.g WHEN jb IS NOT NULL THEN 0 END, 6) AS trail_brake_m,
  round(CASE WHEN jp < 49 THEN xp.g - xp.lo END, 6) AS throttle_point_m,
  round(CASE WHEN jp < 49 THEN (xe.th - xp.th) / (xe.g - xp.g) END, 6) AS throttle_ramp, CAST(round_even(xa.gear, 0) AS INT) AS gear
FROM apex LEFT JOIN br USING (lap_id, corner_number) LEFT JOIN pw USING (lap_id, corner_number)
JOIN tr xa ON xa.lap_id = apex.lap_id AND xa.corner_number = apex.corner_number AND xa.j = ja
JOIN tr xe ON xe.lap_id = apex.lap_id AND xe.corner_number = apex.corner_number AND xe.j = 49
LEFT JOIN tr xb ON xb.lap_id = apex.lap_id AND xb.corner_number = apex.corner_number AND xb.j = jb
LEFT JOIN tr xp ON xp.lap_id = apex.lap_id AND xp.corner_number = apex.corner_number AND xp.j = jp""".replace(
    "SELECT lap_id, corner_number, round(min_speed", "SELECT apex.lap_id, apex.corner_number, round(min_speed"
)


@query("corner_features", FEATURES_SQL)
def _(t):
    features = K.corner_features(K.corner_traces(t.telemetry, CORNERS))
    return rounded(features.select("lap_id", "corner_number", *K.FEATURES, "gear"))


@query("lowpass_filtfilt", "SELECT lap_id, sample_idx, round(v, 6) AS smooth_kmh FROM smooth_kmh")
def _(t):
    laps = t.telemetry.withColumn("smooth_kmh", lowpass("speed_kmh", "time_s"))
    return rounded(T.samples(laps, ["lap_id"], "smooth_kmh"))


@query("longitudinal_accel", "SELECT lap_id, sample_idx, round(v, 6) AS accel_ms2 FROM smooth_accel")
def _(t):
    laps = t.telemetry.withColumn("accel_ms2", longitudinal_accel("speed_kmh", "time_s"))
    return rounded(T.samples(laps, ["lap_id"], "accel_ms2"))


@query("lateral_accel", "SELECT lap_id, sample_idx, round(v, 6) AS lateral_ms2 FROM side_accel")
def _(t):
    laps = t.telemetry.withColumn("lateral_ms2", lateral_accel("x", "y", "time_s"))
    return rounded(T.samples(laps, ["lap_id"], "lateral_ms2"))


@query(
    "accel_samples",
    f"""WITH picks AS (SELECT lap_id FROM tlap WHERE session_type = 'R' AND is_representative
      QUALIFY row_number() OVER (PARTITION BY {GK}, driver ORDER BY lap_time_s, lap_id) <= 5)
    SELECT {LAP_SQL}, sample_idx, round(speed_kmh, 6) AS speed_kmh, round(a.v, 6) AS accel_ms2
    FROM tel JOIN picks USING (lap_id) JOIN smooth_accel a USING (lap_id, sample_idx) JOIN side_accel l USING (lap_id, sample_idx)
    WHERE throttle >= 98 AND NOT brake AND abs(l.v) < 2 AND abs(a.v) <= 20""",
)
def _(t):
    return rounded(T.accel_samples(t.telemetry))


@query(
    "clip_detection",
    f"""SELECT {LAP_SQL}, CAST(island AS BIGINT) AS island, round(start_m, 6) AS start_m, round(end_m, 6) AS end_m, round(peak_kmh, 6) AS peak_kmh, round(peak_at_m, 6) AS peak_at_m,
    round(clip_m, 6) AS clip_m, round(depletion_m, 6) AS depletion_m, round(superclip_m, 6) AS superclip_m, round(drop_kmh, 6) AS drop_kmh, end_reason, is_clip, clip_type,
    round(CASE WHEN is_clip THEN coalesce(worst, 0) ELSE 0 END, 6) AS clip_severity_ms2, method FROM clip""",
)
def _(t):
    return rounded(T.detect_clipping(K.fastest(t.telemetry, "is_representative")))


@query("clip_summary", "SELECT * FROM clip_total")
def _(t):
    return T.clip_summary(t.clip_straights)


@query(
    "straight_rows",
    """SELECT lap_id, CAST(round_even(start_m, 0) AS INT) AS start_m, CAST(round_even(end_m, 0) AS INT) AS end_m, CAST(round_even(peak_kmh, 0) AS INT) AS peak_kmh,
    CAST(round_even(peak_at_m, 0) AS INT) AS peak_at_m, CAST(round_even(clip_m, 0) AS INT) AS clip_m, CAST(round_even(depletion_m, 0) AS INT) AS depletion_m,
    CAST(round_even(superclip_m, 0) AS INT) AS superclip_m, CAST(round_even(drop_kmh, 0) AS INT) AS drop_kmh, end_reason, is_clip, clip_type,
    round_even(CASE WHEN is_clip THEN coalesce(worst, 0) ELSE 0 END, 2) AS clip_severity_ms2, method FROM clip""",
)
def _(t):
    return T.straight_rows(t.clip_straights).select("lap_id", F.inline("straights"))


@query("dtw_distance")
def _(t):
    from stintwise.functions.kernels import dtw_distance

    # Each lap's corner against the same corner on the session's first lap.
    traces = K.corner_traces(t.telemetry, CORNERS)
    first = F.min_by(F.struct("speed_kmh"), "lap_id")
    best = (
        traces.groupBy(*SESSION_KEYS, "corner_number")
        .agg(first.alias("_best"))
        .select(*SESSION_KEYS, "corner_number", F.col("_best.speed_kmh").alias("reference"))
    )
    return rounded(
        traces.join(best, [*SESSION_KEYS, "corner_number"]).select(
            "lap_id", "corner_number", dtw_distance("speed_kmh", "reference").alias("dtw_kmh")
        )
    )


@query("corner_fingerprint")
def _(t):
    return rounded(K.fingerprints(t.telemetry, CORNERS))


FEATURE_ROWS = FEATURES_SQL.replace("round(", "(").replace(", 6) AS", ") AS")


@query(
    "feature_mean",
    f"""SELECT year, round, driver, corner_number, {", ".join(f"round(avg({c}), 6) AS {c}" for c in K.FEATURES)},
    CAST(round_even(avg(gear), 0) AS INT) AS gear, count(*) AS clean_laps FROM ({FEATURE_ROWS}) JOIN tlap USING (lap_id) GROUP BY year, round, driver, corner_number""",
)
def _(t):
    features = K.corner_features(K.corner_traces(t.telemetry, CORNERS))
    return rounded(K.feature_mean(features, [*WEEKEND_KEYS, "driver", "corner_number"]))
