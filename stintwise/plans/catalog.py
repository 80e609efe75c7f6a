"""Catalog, schedule and result queries."""

import uuid

from pyspark.sql import functions as F

from stintwise.constants import RACE_LIKE, SESSION_KEYS, WEEKEND_KEYS
from stintwise.operators import catalog as C
from stintwise.plans.columns import rounded
from stintwise.plans.registry import query
from stintwise.session import shared_folder
from stintwise.sources.sink import read_sessions, replace_sessions

NOW_TEXT = "1998-08-15 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


@query(
    "weekend_catalog",
    """SELECT year, round, session_type, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_partkey, driver)) AS status,
    max(l_shipdate) AS ingest_ts FROM lap_base GROUP BY ALL""",
)
def _(t):
    rows = t.entries.select(
        *SESSION_KEYS,
        F.col("l_returnflag").alias("status"),
        F.col("l_shipdate").alias("ingest_ts"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "driver",
    )
    order = ["ingest_ts", "l_orderkey", "l_linenumber", "l_partkey", "driver"]
    before = rows.where(F.year("ingest_ts") < 1998)
    after = rows.where(F.year("ingest_ts") >= 1998)
    return C.upsert(before, after, SESSION_KEYS, *order).select(
        *SESSION_KEYS, "status", "ingest_ts"
    )


@query("session_enumeration", "SELECT year, round, CAST(slot AS INT) AS slot, name, code FROM scheduled")
def _(t):
    return C.session_slots(t.calendar).drop("start_utc")


@query("session_schedule", "SELECT year, round, CAST(slot AS INT) AS slot, name, code, start_utc FROM scheduled")
def _(t):
    return C.session_slots(t.calendar)


READY = f"""SELECT year, round, CAST(slot AS INT) AS slot, name, code, start_utc FROM scheduled
WHERE start_utc + (CASE code WHEN 'R' THEN 180 WHEN 'SQ' THEN 105 WHEN 'SPRINT' THEN 105 ELSE 120 END) * INTERVAL 1 MINUTE
      <= {NOW_SQL}"""


@query("ready_sessions", READY)
def _(t):
    return C.ready_sessions(C.session_slots(t.calendar), now())


@query(
    "usable_sessions",
    """SELECT year, round, session_type, count(DISTINCT driver) AS drivers FROM laps
    WHERE (year, round, session_type) IN (SELECT (year, round, session_type) FROM tlap)
    GROUP BY ALL HAVING count(DISTINCT driver) >= 5""",
)
def _(t):
    return C.usable_sessions(t.laps, t.telemetry)


@query(
    "new_sessions",
    f"""SELECT * FROM ({READY}) r WHERE NOT EXISTS (SELECT 1 FROM laps l WHERE l.year = r.year
    AND l.round = r.round AND l.session_type = r.code AND l.year < 1997)""",
)
def _(t):
    ready = C.ready_sessions(C.session_slots(t.calendar), now())
    return C.new_sessions(ready, t.sessions.where(F.col("year") < 1997)).select(
        *WEEKEND_KEYS, "slot", "name", "code", "start_utc"
    )


@query(
    "session_status",
    f"""SELECT s.year, s.round, CAST(slot AS INT) AS slot, name, code, start_utc,
    CASE WHEN l.session_type IS NOT NULL THEN 'loaded'
         WHEN start_utc + INTERVAL 6 HOUR <= {NOW_SQL} THEN 'unavailable' END AS status
    FROM scheduled s LEFT JOIN (SELECT DISTINCT year, round, session_type FROM laps WHERE year < 1997) l
    ON s.year = l.year AND s.round = l.round AND s.code = l.session_type""",
)
def _(t):
    ingested = t.sessions.where(F.col("year") < 1997)
    return C.session_status(C.session_slots(t.calendar), ingested, now())


@query("season_schedule", "SELECT * FROM season_events")
def _(t):
    return C.season_schedule(t.calendar)


@query(
    "next_event",
    f"""SELECT *, greatest(0, date_sub('day', {NOW_SQL}, event_start)) AS days_until FROM season_events
    WHERE event_start > {NOW_SQL} ORDER BY event_start, year, round LIMIT 1""",
)
def _(t):
    return C.next_event(C.season_schedule(t.calendar), now())


@query(
    "completed_rounds",
    f"SELECT year, round FROM season_events WHERE round > 0 AND event_start <= {NOW_SQL}",
)
def _(t):
    return C.completed_rounds(C.season_schedule(t.calendar), now()).orderBy(*WEEKEND_KEYS)


WINDOW_NOW = "1998-04-01 03:00:00"


@query(
    "round_window",
    f"""SELECT year, round FROM season_events
    WHERE event_start BETWEEN TIMESTAMP '{WINDOW_NOW}' - INTERVAL 6 HOUR AND TIMESTAMP '{WINDOW_NOW}' + INTERVAL 3 DAY""",
)
def _(t):
    at = F.lit(WINDOW_NOW).cast("timestamp_ntz")
    return C.round_window(C.season_schedule(t.calendar), at).orderBy(*WEEKEND_KEYS)


RESULT_COLUMNS = """year, round, session_type, position, driver, constructor,
 round(gap_to_leader_s, 6) AS gap_to_leader_s, round(total_time_s, 6) AS total_time_s, laps, leader_laps, status,
 round(q1_time_s, 6) AS q1_time_s, round(q2_time_s, 6) AS q2_time_s, round(q3_time_s, 6) AS q3_time_s"""


@query("session_results", f"SELECT {RESULT_COLUMNS} FROM results")
def _(t):
    return rounded(C.session_results(t.results_raw))


@query("results_order", f"SELECT {RESULT_COLUMNS} FROM results WHERE session_type = 'R'")
def _(t):
    race = t.results.where(F.col("session_type") == "R")
    return rounded(race).orderBy(*SESSION_KEYS, F.asc_nulls_last("position"))


@query(
    "driver_constructor",
    """SELECT year, round, driver, arg_max(constructor, list_position(['FP1','FP2','FP3','SQ','SPRINT','Q','R'], session_type))
    AS constructor FROM results GROUP BY ALL""",
)
def _(t):
    return C.driver_constructor(t.results)


@query(
    "pick_session",
    """SELECT year, round, min_by(session_type, list_position(['SPRINT','R'], session_type)) AS session_type
    FROM (SELECT DISTINCT year, round, session_type FROM laps WHERE session_type IN ('R', 'SPRINT')) GROUP BY ALL""",
)
def _(t):
    return C.pick_session(t.sessions, ["SPRINT", "R"])


@query(
    "indicative_sessions",
    """SELECT DISTINCT year, round, session_type, session_type IN ('FP1', 'FP2', 'FP3', 'SQ') AS indicative FROM laps""",
)
def _(t):
    from stintwise.constants import INDICATIVE

    return t.sessions.withColumn("indicative", F.col("session_type").isin(INDICATIVE))


@query("weekend_list", "SELECT year, round, event_name, country, location FROM calendar")
def _(t):
    return t.calendar.select(*WEEKEND_KEYS, "event_name", "country", "location").orderBy(
        *WEEKEND_KEYS
    )


@query(
    "weekend_detail",
    """SELECT c.year, c.round, event_name, CAST(r.laps AS INT) AS race_laps FROM calendar c
    LEFT JOIN results r ON r.year = c.year AND r.round = c.round AND r.session_type = 'R' AND r.position = 1""",
)
def _(t):
    weekends = t.calendar.select(*WEEKEND_KEYS, "event_name")
    return C.weekend_detail(weekends, t.results).orderBy(*WEEKEND_KEYS)


@query(
    "items_by_weekend",
    "SELECT c.year, c.round, event_name, slot, constructor, header FROM calendar c LEFT JOIN items i USING (year, round)",
)
def _(t):
    return C.items_by_weekend(t.calendar.select(*WEEKEND_KEYS, "event_name"), t.items)


@query(
    "items_of_season",
    "SELECT c.year, c.round, event_name, slot, constructor, header FROM calendar c LEFT JOIN items i USING (year, round) WHERE c.year = 1995",
)
def _(t):
    return C.items_by_weekend(t.calendar.select(*WEEKEND_KEYS, "event_name"), t.items, year=1995)


@query(
    "latest_item",
    """SELECT year, round, event_name, slot, constructor, header FROM items JOIN calendar USING (year, round)
    ORDER BY year DESC, round DESC, slot LIMIT 1""",
)
def _(t):
    return C.latest_item(t.items, t.calendar.select(*WEEKEND_KEYS, "event_name"))


@query(
    "needs_generation",
    """SELECT year, round, event_name, 'race' AS model FROM calendar WHERE (year, round) IN (SELECT (year, round) FROM laps WHERE session_type IN ('R', 'SPRINT'))
      AND (year, round) NOT IN (SELECT (year, round) FROM items)
    UNION ALL SELECT year, round, event_name, 'qualifying' FROM calendar WHERE (year, round) IN (SELECT (year, round) FROM laps WHERE session_type = 'Q')
      AND (year, round) NOT IN (SELECT (year, round) FROM quali_row WHERE session_type = 'Q')""",
)
def _(t):
    """Weekends whose race or qualifying was run and has nothing published: of races the texts on pace, of
    qualifying those on the cars that were measured."""
    weekends = t.calendar.select(*WEEKEND_KEYS, "event_name")
    measured = t.quali_rows.where(F.col("session_type") == "Q").select(*WEEKEND_KEYS).distinct()
    ran = F.col("session_type")
    race = C.needs_generation(weekends, t.items, t.sessions.where(ran.isin(RACE_LIKE)))
    quali = C.needs_generation(weekends, measured, t.sessions.where(ran == "Q"))
    return race.withColumn("model", F.lit("race")).unionByName(
        quali.withColumn("model", F.lit("qualifying"))
    )


@query(
    "sink_replace_sessions",
    """SELECT year, round, session_type, count(*) AS drivers, CAST(sum(CASE WHEN year = 2000 THEN 2 ELSE 1 END) AS BIGINT) AS version_sum
    FROM results GROUP BY ALL""",
)
def _(t):
    path = f"{shared_folder(t.spark)}/sink-{uuid.uuid4().hex}"
    rows = t.results.select(*SESSION_KEYS, "driver", F.lit(1).alias("version"))
    replace_sessions(rows, path)
    again = rows.where(F.col("year") == 2000).withColumn("version", F.lit(2))
    replace_sessions(again, path)
    return (
        read_sessions(t.spark, path, rows.schema)
        .groupBy(*SESSION_KEYS)
        .agg(F.count("*").alias("drivers"), F.sum("version").alias("version_sum"))
    )
