"""Event-log and ingest queries. Streams run over the given tables until none is left."""

import uuid

from pyspark.sql import functions as F

from stintwise.constants import (
    HALF_LIFE_ROUNDS,
    MOST_FROM_ADDRESS,
    MOST_TO_EMAIL,
    SESSION_KEYS,
    WEEKEND_KEYS,
)
from stintwise.operators import catalog as C
from stintwise.operators import laps as L
from stintwise.operators import pace as P
from stintwise.operators import season as N
from stintwise.plans.columns import rounded
from stintwise.plans.registry import query
from stintwise.session import shared_folder, work_table
from stintwise.sources.landing import RAW
from stintwise.sources.sink import read_sessions
from stintwise.streaming import events as E
from stintwise.streaming import ingest as I


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def as_actions(events):
    """Sign-ups as requests and purchases as confirmations, by user."""
    kind = F.when(F.col("event_type") == "signup", "request").when(
        F.col("event_type") == "purchase", "confirm"
    )
    return (
        events.withColumn("action", kind)
        .where(F.col("action").isNotNull())
        .select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", "action")
    )


HOUR_BEFORE = "ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


@query(
    "rate_limit",
    f"""SELECT event_id, user_id, address, from_address, to_user, from_address >= 5 OR to_user >= 3 AS blocked FROM (
      SELECT *, count(*) FILTER (event_type IN ('signup', 'error')) OVER (PARTITION BY address {HOUR_BEFORE}) AS from_address,
        count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id {HOUR_BEFORE}) AS to_user
      FROM (SELECT *, user_id // 10 AS address FROM events)) WHERE event_type = 'signup'""",
)
def _(t):
    """Sign-ups held by both limits: five sign-ups or refusals of one address, three mails to one user."""
    kind = F.col("event_type")
    log = t.raw("events").select(
        "event_id", "user_id", F.floor(F.col("user_id") / 10).alias("address"), "ts", "event_type"
    )
    limits = {
        "from_address": E.Limit("address", kind.isin("signup", "error"), MOST_FROM_ADDRESS),
        "to_user": E.Limit("user_id", kind == "purchase", MOST_TO_EMAIL),
    }
    return E.rate_limit(log, kind == "signup", limits).drop("ts", "event_type")


CONFIRMED = """WITH a AS (SELECT event_id, user_id, ts, event_type, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts
  FROM events WHERE event_type IN ('signup', 'purchase')
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'signup' THEN 0 ELSE 1 END, event_id))
SELECT event_id AS request_id, user_id AS key, CASE WHEN next_type = 'purchase' AND next_ts <= ts + INTERVAL 24 HOUR THEN next_id END AS confirm_id,
 CASE WHEN next_type = 'purchase' AND next_ts <= ts + INTERVAL 24 HOUR THEN 'confirmed' ELSE 'expired' END AS outcome
FROM a WHERE event_type = 'signup'"""


@query("confirmed_in_ttl", CONFIRMED)
def _(t):
    return E.confirmed_in_ttl(as_actions(t.raw("events")))


@query(
    "confirmations_stream",
    CONFIRMED + """ AND (next_ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM a)
      OR ts + INTERVAL 24 HOUR < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM a))""",
)
def _(t):
    """What the watermark has settled, six hours behind the last action."""
    rows = E.read_events(t.spark, t.sf_dir, "events.parquet", RAW["events"])
    out = folder(t, "confirmations")
    E.run_once(E.confirmations_stream(as_actions(rows), "6 hours"), out, f"{out}-state")
    return t.spark.read.schema(E.OUTCOMES).parquet(out)


@query(
    "subscription_state",
    """SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id""",
)
def _(t):
    rows = t.raw("events").select(
        F.col("user_id").alias("key"),
        F.col("event_type").alias("status"),
        "ts",
        F.col("event_id").alias("id"),
    )
    return E.subscription_state(rows)


CUT = "2024-01-15 00:00:00"


@query(
    "change_log",
    f"""WITH b AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS secret FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY ALL),
    a AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS secret FROM events WHERE user_id % 7 <> 0 GROUP BY ALL)
    SELECT key, CASE WHEN b.status IS NULL THEN 'row_inserted' WHEN a.status IS NULL THEN 'row_deleted' ELSE 'row_updated' END AS action,
      CASE WHEN b.status IS NOT NULL THEN '{{"key":' || key || ',"status":"' || b.status || '"}}' END AS old_data,
      CASE WHEN a.status IS NOT NULL THEN '{{"key":' || key || ',"status":"' || a.status || '"}}' END AS new_data
    FROM b FULL JOIN a USING (key) WHERE b.status IS NULL OR a.status IS NULL OR b.status <> a.status OR b.secret <> a.secret""",
)
def _(t):
    def snapshot(rows):
        return rows.groupBy(F.col("user_id").alias("key")).agg(
            F.max_by("event_type", F.struct("ts", "event_id")).alias("status"),
            F.max("event_id").alias("secret"),
        )

    events = t.raw("events")
    before = snapshot(events.where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")))
    after = snapshot(events.where(F.col("user_id") % 7 != 0))
    return E.change_log(before, after, "key", "secret")


@query(
    "change_log_stream",
    """SELECT user_id AS key, event_id AS id, CASE WHEN n IS NULL THEN 'row_deleted' WHEN o IS NULL THEN 'row_inserted' ELSE 'row_updated' END AS action,
      o AS old_data, n AS new_data
    FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM (SELECT *,
      CASE WHEN event_type <> 'error' THEN '{"status":"' || event_type || '","value":' || (floor(value * 100))::BIGINT || '}' END AS n FROM events))
    WHERE n IS NOT NULL OR o IS NOT NULL""",
)
def _(t):
    """Every event writes its user's row, with a token that no log may show; an error deletes it."""
    rows = E.read_events(t.spark, t.sf_dir, "events.parquet", RAW["events"])
    row = F.to_json(
        F.struct(
            F.col("event_type").alias("status"),
            F.floor(F.col("value") * 100).alias("value"),
            F.sha2(F.col("event_id").cast("string"), 256).alias("token"),
        )
    )
    written = F.when(F.col("event_type") != "error", row)
    images = rows.select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("id"),
        "ts",
        E.without_secret(written, "status string, value bigint, token string", "token").alias("image"),
    )
    out = folder(t, "changes")
    E.run_once(E.change_log_stream(images), out, f"{out}-state")
    return t.spark.read.schema(E.LOG_SCHEMA).parquet(out)


@query(
    "windowed_counts_stream",
    """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total
    FROM (SELECT *, date_trunc('hour', ts) AS window_start FROM events) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)
    GROUP BY ALL""",
)
def _(t):
    rows = E.read_events(t.spark, t.sf_dir, "events.parquet", RAW["events"])
    out = folder(t, "windows")
    E.run_once(E.windowed_counts(rows, "1 hour", "6 hours"), out, f"{out}-state")
    schema = "window_start TIMESTAMP, window_end TIMESTAMP, event_type STRING, n BIGINT, total DOUBLE"
    kept = t.spark.read.schema(schema).parquet(out)
    return rounded(
        kept.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
            "window_end", F.col("window_end").cast("timestamp_ntz")
        )
    )


@query(
    "incremental_ingest",
    """SELECT year, round, session_type, count(*) AS laps, count(DISTINCT driver) AS drivers FROM laps
    GROUP BY ALL HAVING count(DISTINCT driver) >= 5""",
)
def _(t):
    landing, target = folder(t, "landing"), folder(t, "ingested")
    I.land(t.laps, landing, ranged=True)
    I.ingest(t.spark, landing, target, folder(t, "ingest-state"), t.laps.schema)
    done = read_sessions(t.spark, target, t.laps.schema)
    return done.groupBy(*SESSION_KEYS).agg(
        F.count("*").alias("laps"), F.count_distinct("driver").alias("drivers")
    )


USABLE = "SELECT year, round, session_type FROM laps GROUP BY ALL HAVING count(DISTINCT driver) >= 5"
WEEKEND = "session_type STRING, constructor STRING, median_s DOUBLE, gap_s DOUBLE, n_laps BIGINT, year INT, round INT"
ROUNDS = "constructor STRING, n BIGINT, mean DOUBLE, m2 DOUBLE, year INT, round INT"
SEASON = "constructor STRING, mean DOUBLE, spread DOUBLE, n BIGINT, recent_mean DOUBLE, year INT"


def recomputed(t) -> dict[str, I.Output]:
    """The outputs of one run of ingest and recompute, which the queries share."""
    if "recomputed" not in t.__dict__:
        t.__dict__["recomputed"] = recompute_in_parts(t)
    return t.__dict__["recomputed"]


def recompute_in_parts(t) -> dict[str, I.Output]:
    """The outputs kept up by ingest, after practice and qualifying came first and the races later: team
    pace by weekend on any session, the races' sums by round and the season on a race alone."""
    schema = t.laps.schema

    def like(ddl: str):
        return t.spark.createDataFrame([], ddl).schema

    def team_pace(laps):
        kept = L.pace_laps(L.gap_to_car_ahead(laps, prunable=True))
        kept = kept.select(*L.STINT_KEYS, "constructor", "lap_number", "pace_s")
        paced = work_table(L.without_opening_lap(kept, laps), "paced")  # quantiles read it more than once
        return P.constructor_median_gaps(paced).select(*like(WEEKEND).names)

    def race_sums(pace):
        race = C.pick_session(pace.select(*SESSION_KEYS).distinct(), ["R", "SPRINT"])
        value = F.col("gap_s").alias("value")
        return N.round_sums(pace.join(race, SESSION_KEYS).select(*WEEKEND_KEYS, "constructor", value))

    landing, target = folder(t, "landing"), folder(t, "ingested")
    pace, rounds, season = (folder(t, name) for name in ("pace", "rounds", "season"))
    races = frozenset({"R", "SPRINT"})
    outputs = {
        "pace": I.Output(pace, like(WEEKEND), WEEKEND_KEYS, None, target, schema, SESSION_KEYS, team_pace),
        "rounds": I.Output(rounds, like(ROUNDS), WEEKEND_KEYS, races, pace, like(WEEKEND), WEEKEND_KEYS, race_sums),
        "season": I.Output(season, like(SEASON), ["year"], races, rounds, like(ROUNDS), WEEKEND_KEYS, N.season_of_rounds),
    }
    hook = I.recompute(t.spark, list(outputs.values()))
    state = folder(t, "ingest-state")
    race = F.col("session_type").isin(*races)
    for part in (t.laps.where(~race), t.laps.where(race)):
        I.land(part, landing, ranged=True)
        I.ingest(t.spark, landing, target, state, schema, hook)
    return outputs


def published(t, out: I.Output):
    return read_sessions(t.spark, out.path, out.schema, out.keys)


@query(
    "affected_recompute",
    f"""SELECT year, round, session_type, constructor, round(median_s, 6) AS median_s, n_laps FROM team_pace
    WHERE (year, round, session_type) IN ({USABLE})""",
)
def _(t):
    return rounded(published(t, recomputed(t)["pace"])).select(*SESSION_KEYS, "constructor", "median_s", "n_laps")


@query(
    "season_recompute",
    f"""WITH usable AS ({USABLE}), race AS (SELECT year, round, CASE WHEN bool_or(session_type = 'R') THEN 'R' ELSE 'SPRINT' END AS session_type
      FROM usable WHERE session_type IN ('R', 'SPRINT') GROUP BY ALL),
    v AS (SELECT year, round, constructor, gap_s, max(round) OVER (PARTITION BY year) AS c FROM team_pace JOIN race USING (year, round, session_type))
    SELECT year, constructor, round(avg(gap_s), 6) AS mean, round(stddev_pop(gap_s), 6) AS spread, count(*) AS n,
      round(sum(gap_s * pow(0.5, (c - round) / {HALF_LIFE_ROUNDS:.1f})) / sum(pow(0.5, (c - round) / {HALF_LIFE_ROUNDS:.1f})), 6) AS recent_mean
    FROM v GROUP BY year, constructor""",
)
def _(t):
    """The season as the races left it, from the rounds' sums."""
    return rounded(published(t, recomputed(t)["season"]))
