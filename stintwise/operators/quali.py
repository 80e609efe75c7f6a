"""Sector bests across sessions and qualifying car character. Rows are one per driver or team."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    KMH_TO_MPH,
    MIN_CORNER_LOSS_KMH,
    SESSION_KEYS,
    SESSION_ORDER,
    TOP_TEAMS,
    WEEKEND_KEYS,
)
from stintwise.functions.skew import first_by
from stintwise.operators.catalog import session_rank

TEAM_KEYS = [*SESSION_KEYS, "constructor"]


def best_across_sessions(bests: DataFrame) -> DataFrame:
    """Best of each driver and sector over a weekend's sessions, with the session it came from."""
    return bests.groupBy(*WEEKEND_KEYS, "driver", "sector").agg(
        F.min("constructor").alias("constructor"),
        F.min("best_time_s").alias("best_time_s"),
        F.min_by("session_type", F.struct("best_time_s", session_rank(SESSION_ORDER))).alias(
            "session_type"
        ),
    )


def sector_dominance(bests: DataFrame, keys: list[str]) -> DataFrame:
    """Fastest constructor per sector, the driver who set the time and the margin to the next."""
    teams = (
        bests.where(F.col("constructor").isNotNull())
        .groupBy(*keys, "sector", "constructor")
        .agg(
            F.min("best_time_s").alias("best_time_s"),
            F.min_by("driver", F.struct("best_time_s", "driver")).alias("driver"),
        )
    )
    order = Window.partitionBy(*keys, "sector").orderBy("best_time_s", "constructor")
    return (
        teams.withColumn("_place", F.row_number().over(order))
        .withColumn("margin_s", F.lead("best_time_s").over(order) - F.col("best_time_s"))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def best_top_speeds(zones: DataFrame) -> DataFrame:
    best = zones.groupBy(*WEEKEND_KEYS, "driver").agg(
        F.min("constructor").alias("constructor"),
        F.max("max_speed_kmh").alias("max_speed_kmh"),
        F.min_by("session_type", F.struct(-F.col("max_speed_kmh"), session_rank())).alias(
            "session_type"
        ),
    )
    return best.withColumn("max_speed_mph", F.col("max_speed_kmh") * F.lit(KMH_TO_MPH))


def fastest_per_constructor(rows: DataFrame) -> DataFrame:
    named = rows.where(F.col("constructor").isNotNull() & F.col("lap_time_s").isNotNull())
    return first_by(named, TEAM_KEYS, "lap_time_s", "driver")


def top_teams(reps: DataFrame, n: int = TOP_TEAMS) -> DataFrame:
    order = Window.partitionBy(*SESSION_KEYS).orderBy("lap_time_s", "constructor")
    return reps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def fastest_corner(reps: DataFrame, corner_speeds: DataFrame) -> DataFrame:
    """The corner with the highest mean speed among those where cars really slow down."""
    slowed = (
        corner_speeds.drop("lap_time_s", "constructor")
        .join(
            reps.select(*SESSION_KEYS, "driver", "lap_id", "top_speed_kmh"),
            [*SESSION_KEYS, "driver", "lap_id"],
        )
        .where(F.col("top_speed_kmh") - F.col("min_speed_kmh") >= MIN_CORNER_LOSS_KMH)
    )
    means = slowed.groupBy(*SESSION_KEYS, "corner_number").agg(
        F.avg("min_speed_kmh").alias("mean_kmh")
    )
    return means.groupBy(*SESSION_KEYS).agg(
        F.max_by("corner_number", F.struct("mean_kmh", -F.col("corner_number"))).alias(
            "corner_number"
        ),
        F.max("mean_kmh").alias("mean_kmh"),
    )


def rank_desc(value: str, keys: list[str], tie: str = "constructor") -> Column:
    return F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), tie)
    )


def rank_asc(value: str, keys: list[str], tie: str = "constructor") -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value), tie))


def car_character(reps: DataFrame, corner_speeds: DataFrame) -> DataFrame:
    """Drag label of each top team from its ranks within the compared teams."""
    teams = top_teams(reps)
    chosen = fastest_corner(teams, corner_speeds).select(*SESSION_KEYS, "corner_number")
    through = (
        corner_speeds.join(chosen, [*SESSION_KEYS, "corner_number"])
        .select(*SESSION_KEYS, "lap_id", F.col("min_speed_kmh").alias("fastest_corner_kmh"))
    )
    rows = teams.join(through, [*SESSION_KEYS, "lap_id"], "left")
    half = F.ceil(F.count("*").over(Window.partitionBy(*SESSION_KEYS)) / 2)
    ranked = (
        rows.withColumn("_half", half)
        .withColumn("_speed", rank_desc("top_speed_kmh", SESSION_KEYS))
        .withColumn("_throttle", rank_desc("full_throttle_share", SESSION_KEYS))
        .withColumn("_corner", rank_desc("fastest_corner_kmh", SESSION_KEYS))
        .withColumn("_grip", rank_desc("min_speed_kmh", SESSION_KEYS))
    )
    fast = lambda r: F.col(r) <= F.col("_half")
    label = (
        F.when(fast("_speed") & fast("_throttle"), "efficient, low drag")
        .when(~fast("_speed") & fast("_corner"), "draggy, high-downforce")
        .when(~fast("_speed") & ~fast("_throttle"), "lacks efficiency")
        .otherwise("balanced")
    )
    return ranked.select(
        *TEAM_KEYS,
        "driver",
        "place",
        "lap_time_s",
        "top_speed_kmh",
        "min_speed_kmh",
        "full_throttle_share",
        "fastest_corner_kmh",
        label.alias("drag_label"),
        (F.col("_speed") == 1).alias("is_top_speed_leader"),
        (F.col("_corner") == 1).alias("is_corner_speed_leader"),
        (F.col("_grip") == 1).alias("is_grip_leader"),
    )


def with_sector_leaders(cars: DataFrame, dominance: DataFrame) -> DataFrame:
    """Each car's row with the best time of every sector of its session, the team that set it and its
    margin."""
    def of(column: str, sector: int) -> Column:
        return F.max(F.when(F.col("sector") == sector, F.col(column)))

    leaders = dominance.groupBy(*SESSION_KEYS).agg(
        *[
            of(column, k).alias(f"sector{k}_{name}")
            for k in (1, 2, 3)
            for column, name in (("best_time_s", "best_s"), ("constructor", "team"), ("margin_s", "margin_s"))
        ]
    )
    return cars.join(leaders, SESSION_KEYS, "left")
