"""Weekends, sessions, schedules, results and published items."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    DATA_LAG_MINUTES,
    MIN_SESSION_DRIVERS,
    QUALI_LIKE,
    RACE_LIKE,
    SESSION_CODES,
    SESSION_KEYS,
    SESSION_MINUTES,
    SESSION_ORDER,
    STALE_AFTER_HOURS,
    WEEKEND_KEYS,
)
from stintwise.functions.expressions import compute_gap, lookup
from stintwise.functions.skew import attach


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Existing and incoming rows with the last write kept per key, combined before the shuffle."""
    rows = existing.unionByName(incoming)
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select(*keys, "_last.*")
    )


def session_slots(calendar: DataFrame) -> DataFrame:
    """The five wide session slots of each event as rows; the UTC start is preferred."""
    slots = [
        F.struct(
            F.lit(k).alias("slot"),
            F.col(f"session{k}").alias("name"),
            F.coalesce(f"session{k}_date_utc", f"session{k}_date").alias("start_utc"),
        )
        for k in range(1, 6)
    ]
    return (
        calendar.select(*WEEKEND_KEYS, F.inline(F.array(*slots)))
        .withColumn("code", lookup(SESSION_CODES, F.col("name")))
        .where(F.col("code").isNotNull())
    )


def ready_at() -> Column:
    minutes = F.coalesce(lookup(SESSION_MINUTES, F.col("code")), F.lit(60)) + DATA_LAG_MINUTES
    return F.col("start_utc") + F.make_dt_interval(mins=minutes)


def ready_sessions(slots: DataFrame, now: Column) -> DataFrame:
    return slots.where(ready_at() <= now)


def usable_sessions(laps: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Sessions with enough drivers that also have telemetry."""
    seen = telemetry.select(*SESSION_KEYS).distinct()
    return (
        laps.groupBy(*SESSION_KEYS)
        .agg(F.count_distinct("driver").alias("drivers"))
        .where(F.col("drivers") >= MIN_SESSION_DRIVERS)
        .join(seen, SESSION_KEYS, "left_semi")
    )


def new_sessions(ready: DataFrame, ingested: DataFrame, force: bool = False) -> DataFrame:
    if force:
        return ready
    done = ingested.select(*WEEKEND_KEYS, F.col("session_type").alias("code"))
    return ready.join(done, [*WEEKEND_KEYS, "code"], "left_anti")


def session_status(slots: DataFrame, ingested: DataFrame, now: Column) -> DataFrame:
    loaded = ingested.select(
        *WEEKEND_KEYS, F.col("session_type").alias("code"), F.lit("loaded").alias("_status")
    )
    stale = F.col("start_utc") + F.make_dt_interval(hours=F.lit(STALE_AFTER_HOURS)) <= now
    return (
        slots.join(loaded, [*WEEKEND_KEYS, "code"], "left")
        .withColumn("status", F.coalesce("_status", F.when(stale, "unavailable")))
        .drop("_status")
    )


def season_schedule(calendar: DataFrame) -> DataFrame:
    start = F.coalesce("session5_date_utc", "session5_date", "event_date")
    return calendar.select(
        *WEEKEND_KEYS, "event_name", "country", "location", start.alias("event_start")
    ).where(F.col("event_start").isNotNull())


def next_event(events: DataFrame, now: Column) -> DataFrame:
    """The earliest event strictly after `now`, in any later year, with whole days until it."""
    return (
        events.where(F.col("event_start") > now)
        .orderBy("event_start", "year", "round")
        .limit(1)
        .withColumn(
            "days_until",
            F.greatest(F.lit(0), F.timestamp_diff("DAY", now, F.col("event_start"))),
        )
    )


def completed_rounds(events: DataFrame, now: Column) -> DataFrame:
    return events.where((F.col("round") > 0) & (F.col("event_start") <= now)).select(*WEEKEND_KEYS)


def round_window(events: DataFrame, now: Column) -> DataFrame:
    low = now - F.make_dt_interval(hours=F.lit(STALE_AFTER_HOURS))
    high = now + F.make_dt_interval(days=F.lit(3))
    return events.where(F.col("event_start").between(low, high)).select(*WEEKEND_KEYS)


def session_results(raw: DataFrame) -> DataFrame:
    """Classification with safe casts: gaps and winner's time in races, Q times in qualifying."""
    race, quali = F.col("session_type").isin(RACE_LIKE), F.col("session_type").isin(QUALI_LIKE)
    cast = raw.withColumn("position", F.col("position").try_cast("bigint"))
    winner = F.when(F.col("position") == 1, F.col("laps"))
    led = attach(cast, SESSION_KEYS, F.max(winner).alias("leader_laps"), few=True)
    gap = compute_gap(
        F.col("session_type"),
        F.col("position"),
        F.col("time_s"),
        F.col("status"),
        F.col("laps"),
        F.col("leader_laps"),
    )
    return led.select(
        *SESSION_KEYS,
        "position",
        "driver",
        "constructor",
        gap.alias("gap_to_leader_s"),
        F.when(race & (F.col("position") == 1), F.col("time_s")).alias("total_time_s"),
        "laps",
        "leader_laps",
        "status",
        *[F.when(quali, F.col(f"q{k}_time_s")).alias(f"q{k}_time_s") for k in (1, 2, 3)],
    )


def session_rank(order: list[str] = SESSION_ORDER) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.col("session_type"))


def driver_constructor(results: DataFrame) -> DataFrame:
    """Each driver's constructor per weekend, from the latest session that names one."""
    return (
        results.where(F.col("constructor").isNotNull())
        .groupBy(*WEEKEND_KEYS, "driver")
        .agg(F.max_by("constructor", session_rank()).alias("constructor"))
    )


def pick_session(sessions: DataFrame, priority: list[str]) -> DataFrame:
    """The first of `priority` present in each weekend."""
    return (
        sessions.where(F.col("session_type").isin(priority))
        .groupBy(*WEEKEND_KEYS)
        .agg(F.min_by("session_type", session_rank(priority)).alias("session_type"))
    )


def weekend_detail(weekends: DataFrame, results: DataFrame) -> DataFrame:
    """Weekends with the race winner's lap count."""
    won = results.where((F.col("session_type") == "R") & (F.col("position") == 1)).select(
        *WEEKEND_KEYS, F.col("laps").cast("int").alias("race_laps")
    )
    return weekends.join(won, WEEKEND_KEYS, "left")


def latest_item(items: DataFrame, weekends: DataFrame) -> DataFrame:
    return (
        items.join(weekends, WEEKEND_KEYS)
        .orderBy(F.desc("year"), F.desc("round"), "slot")
        .limit(1)
    )


def items_by_weekend(
    weekends: DataFrame, items: DataFrame, year: int | None = None, round: int | None = None
) -> DataFrame:
    """Published items of all weekends, or those of one year, of one round, or of both, in order. A
    weekend without items has one row."""
    for key, value in (("year", year), ("round", round)):
        if value is not None:
            weekends = weekends.where(F.col(key) == value)
    return weekends.join(items, WEEKEND_KEYS, "left").orderBy(*WEEKEND_KEYS, "slot")


def needs_generation(
    weekends: DataFrame, items: DataFrame, analysed: DataFrame, force: bool = False
) -> DataFrame:
    """Analysed weekends for which nothing has been published, or all of them with `force`."""
    found = weekends.join(analysed, WEEKEND_KEYS, "left_semi")
    return found if force else found.join(items, WEEKEND_KEYS, "left_anti")


def published_items(team_pace: DataFrame, slots: int = 3) -> DataFrame:
    """The `slots` teams furthest off the pace of each weekend, as short texts."""
    order = Window.partitionBy(*WEEKEND_KEYS).orderBy(F.desc("gap_s"), "constructor")
    return (
        team_pace.withColumn("slot", F.row_number().over(order))
        .where(F.col("slot") <= slots)
        .select(
            *WEEKEND_KEYS,
            "slot",
            "constructor",
            F.format_string(
                "%s ran %.3f seconds off the pace", "constructor", F.col("gap_s") + F.lit(1e-9)
            ).alias("header"),
        )
    )
