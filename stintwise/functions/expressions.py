"""Column expressions of the racing domain."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintwise.constants import (
    COMPOUND_LETTERS,
    DRIVER_NAMES,
    KMH_TO_MPH,
    LOW_SPEED_KMH,
    MID_SPEED_KMH,
    RACE_LIKE,
    RACE_POINTS,
    SPRINT_POINTS,
)


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant table, null for an unknown key."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def race_points(position: Column) -> Column:
    return F.coalesce(lookup(RACE_POINTS, position), F.lit(0))


def sprint_points(position: Column) -> Column:
    return F.coalesce(lookup(SPRINT_POINTS, position), F.lit(0))


def points_for_session(session_type: Column, position: Column) -> Column:
    return F.when(session_type == "SPRINT", sprint_points(position)).otherwise(
        race_points(position)
    )


def compound_letter(compound: Column) -> Column:
    known = lookup(COMPOUND_LETTERS, F.upper(compound))
    return F.when(F.coalesce(compound, F.lit("")) == "", "?").otherwise(
        F.coalesce(known, F.upper(F.substring(compound, 1, 1)))
    )


def strategy_string(compounds: Column) -> Column:
    return F.array_join(F.transform(compounds, compound_letter), "-")


def format_total_time(seconds: Column) -> Column:
    """H:MM:SS.mmm, without the hours when there are none."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    rest = seconds % 60
    return F.when(
        hours > 0, F.format_string("%d:%02d:%06.3f", hours, minutes, rest)
    ).otherwise(F.when(seconds.isNotNull(), F.format_string("%d:%06.3f", minutes, rest)))


def is_lapped(status: Column, laps: Column, leader_laps: Column) -> Column:
    return F.coalesce(status == "Lapped", F.lit(False)) | F.coalesce(
        laps < leader_laps, F.lit(False)
    )


def laps_down(laps: Column, leader_laps: Column) -> Column:
    down = F.bround(leader_laps - laps).cast("int")
    return F.when(down > 0, down)


def compute_gap(
    session_type: Column,
    position: Column,
    time_s: Column,
    status: Column,
    laps: Column,
    leader_laps: Column,
) -> Column:
    return (
        F.when(~session_type.isin(RACE_LIKE), F.lit(None))
        .when(position == 1, F.lit(0.0))
        .when(is_lapped(status, laps, leader_laps), F.lit(None))
        .otherwise(time_s)
        .cast("double")
    )


def format_gap_label(
    position: Column, gap_s: Column, laps: Column, leader_laps: Column, status: Column
) -> Column:
    word = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    down = F.coalesce(laps_down(laps, leader_laps), F.lit(1))
    return (
        F.when(position == 1, "leader")
        .when(word == "retired", "DNF")
        .when(word == "did not start", "DNS")
        .when(
            is_lapped(F.trim(status), laps, leader_laps),
            F.when(down > 1, F.format_string("+%d Laps", down)).otherwise("+1 Lap"),
        )
        .when(gap_s.isNotNull(), F.format_string("+%.1fs", gap_s))
        .otherwise(F.trim(F.coalesce(status, F.lit(""))))
    )


def mph(kmh: Column) -> Column:
    return kmh * F.lit(KMH_TO_MPH)


def speed_class(kmh: Column) -> Column:
    return F.when(kmh < LOW_SPEED_KMH, "low").when(kmh < MID_SPEED_KMH, "mid").otherwise("high")


def driver_name(code: Column) -> Column:
    return F.coalesce(lookup(DRIVER_NAMES, code), code, F.lit(""))


def normalize_email(raw: Column) -> Column:
    cleaned = F.lower(F.trim(raw))
    valid = (F.length(cleaned) <= 254) & cleaned.rlike(
        r"^[^@\s]{1,64}@[^@\s.]+(\.[^@\s.]+)+$"
    )
    return F.when(valid, cleaned)


def isclose(a: Column, b: Column, rel: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(
        F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)
    )
