"""Lap filters, gaps, stints, sector bests and lap picking."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    DIRTY_AIR_S,
    FUEL_KG_PER_RACE,
    FUEL_SECONDS_PER_KG,
    RACE_LIKE,
    SESSION_KEYS,
)
from stintwise.functions.skew import attach, first_by, neighbours

DRIVER_KEYS = [*SESSION_KEYS, "driver"]
STINT_KEYS = [*DRIVER_KEYS, "stint_number"]


def representative() -> Column:
    """Fit for a single fastest-lap read; a caution at the lap's end does not matter."""
    return (
        F.col("is_accurate")
        & ~F.col("deleted")
        & ~F.col("is_outlap")
        & ~F.col("is_inlap")
        & ~F.col("rainfall")
    )


def clean() -> Column:
    """Representative and green for the whole lap."""
    return representative() & (F.col("track_status") == "1")


def pace_lap() -> Column:
    """Counts towards stint pace. An unknown track status counts as green."""
    return (
        ~F.col("is_outlap")
        & ~F.col("is_inlap")
        & F.col("is_accurate")
        & ~F.col("deleted")
        & (F.coalesce("track_status", F.lit("1")) == "1")
        & F.col("lap_time_s").isNotNull()
    )


def clean_air() -> Column:
    return F.col("gap_s").isNull() | (F.col("gap_s") >= DIRTY_AIR_S)


def clean_laps(laps: DataFrame) -> DataFrame:
    return laps.where(clean())


def representative_laps(laps: DataFrame) -> DataFrame:
    return laps.where(representative())


def clean_lap_counts(laps: DataFrame) -> DataFrame:
    return clean_laps(laps).groupBy(*DRIVER_KEYS).agg(F.count("*").alias("clean_laps"))


def gap_to_car_ahead(laps: DataFrame, prunable: bool = False) -> DataFrame:
    """Seconds behind the car one place ahead on the same lap; the leader has none.

    Places are dense and unique on a lap, so the car ahead is an equality join on place - 1, which
    spreads one lap's cars over all tasks. `prunable` groups the cars ahead by place: Spark then knows
    that a lap meets one at most, and leaves the join out where what follows reads no gap."""
    known = laps.where(F.col("position").isNotNull() & F.col("session_time_s").isNotNull())
    keys = [*SESSION_KEYS, "lap_number", "position"]
    ahead = known.select(
        *SESSION_KEYS,
        "lap_number",
        (F.col("position") + 1).alias("position"),
        F.col("session_time_s").alias("_ahead_s"),
    )
    if prunable:
        ahead = ahead.groupBy(*keys).agg(F.max("_ahead_s").alias("_ahead_s"))
    return (
        laps.join(ahead, keys, "left")
        .withColumn("gap_s", F.col("session_time_s") - F.col("_ahead_s"))
        .drop("_ahead_s")
    )


def fuel_corrected(laps: DataFrame) -> DataFrame:
    """`pace_s`: the lap time with the cost of the fuel still on board taken off, in races only."""
    effect = F.lit(FUEL_SECONDS_PER_KG) * FUEL_KG_PER_RACE / F.col("total_laps")
    corrected = F.col("lap_time_s") - effect * (F.col("total_laps") - F.col("lap_number"))
    return attach(laps, SESSION_KEYS, F.max("lap_number").alias("total_laps"), few=True).withColumn(
        "pace_s",
        F.when(F.col("session_type").isin(RACE_LIKE), corrected).otherwise(F.col("lap_time_s")),
    )


def pace_laps(laps_with_gaps: DataFrame) -> DataFrame:
    """The laps that count for pace, fuel corrected; the lap total spans all laps."""
    return fuel_corrected(laps_with_gaps).where(pace_lap())


def stint_summary(laps_with_gaps: DataFrame) -> DataFrame:
    """One row per stint. Bounds span all its laps, pace only the kept ones; the laps themselves
    stay in long form in `pace_laps`."""
    kept = F.when(pace_lap(), F.col("pace_s"))
    return (
        fuel_corrected(laps_with_gaps)
        .groupBy(*STINT_KEYS)
        .agg(
            F.min_by("compound", F.when(F.col("compound").isNotNull(), F.col("lap_number"))).alias(
                "compound"
            ),
            F.min("constructor").alias("constructor"),
            F.min("lap_number").alias("lap_start"),
            F.max("lap_number").alias("lap_end"),
            F.avg(kept).alias("avg_pace_s"),
            F.count(kept).alias("kept_laps"),
        )
    )


def opening_laps(kept: DataFrame, laps: DataFrame) -> DataFrame:
    """The first kept lap of stint 1, whichever lap that is, where the stint began on lap 1."""
    first_stint = F.col("stint_number") == 1
    started = (
        laps.where(first_stint)
        .groupBy(*DRIVER_KEYS)
        .agg(F.min("lap_number").alias("_start"))
        .where(F.col("_start") == 1)
        .select(*DRIVER_KEYS)
    )
    return (
        kept.where(first_stint)
        .groupBy(*DRIVER_KEYS)
        .agg(F.min("lap_number").alias("lap_number"))
        .join(started, DRIVER_KEYS, "left_semi")
    )


def mark_opening_lap(kept: DataFrame, laps: DataFrame) -> DataFrame:
    marks = opening_laps(kept, laps).withColumn("_opening", F.lit(True))
    return (
        kept.join(marks, [*DRIVER_KEYS, "lap_number"], "left")
        .withColumn("opening", F.col("_opening").isNotNull())
        .drop("_opening")
    )


def without_opening_lap(kept: DataFrame, laps: DataFrame) -> DataFrame:
    return kept.join(opening_laps(kept, laps), [*DRIVER_KEYS, "lap_number"], "left_anti")


def sector_bests(laps: DataFrame) -> DataFrame:
    """Best time of each driver in each sector over laps that were not deleted.

    The minima of all sectors are taken together, of numbers only, before any name is compared: that
    part is a hash aggregate, which neither sorts laps nor makes a row of each sector of a lap."""
    sectors = (1, 2, 3)
    minima = (
        laps.where(~F.coalesce("deleted", F.lit(False)))
        .groupBy(*DRIVER_KEYS, "constructor")
        .agg(*[F.min(f"sector{k}_s").alias(f"_best{k}") for k in sectors])
    )
    timed = lambda k: F.when(F.col(f"_best{k}").isNotNull(), F.col("constructor"))
    best = minima.groupBy(*DRIVER_KEYS).agg(
        *[F.min(timed(k)).alias(f"_name{k}") for k in sectors],
        *[F.min(f"_best{k}").alias(f"_best{k}") for k in sectors],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("sector"),
                F.col(f"_name{k}").alias("constructor"),
                F.col(f"_best{k}").alias("best_time_s"),
            )
            for k in sectors
        ]
    )
    return best.select(*DRIVER_KEYS, F.inline(rows)).where(F.col("best_time_s").isNotNull())


def fastest_lap_per_driver(laps: DataFrame, lap: str = "lap_number") -> DataFrame:
    return first_by(laps.where(F.col("lap_time_s").isNotNull()), DRIVER_KEYS, "lap_time_s", lap)


def fastest_laps_per_driver(laps: DataFrame, n: int = 5, lap: str = "lap_number") -> DataFrame:
    """The `n` fastest laps of each driver; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy(*DRIVER_KEYS).orderBy("lap_time_s", lap)
    return laps.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def weather_asof(laps: DataFrame, weather: DataFrame) -> DataFrame:
    """Rain at the last weather reading at or before each lap's end; null before the first."""
    ends = laps.withColumn("time_s", F.col("session_time_s"))
    return neighbours(ends, weather, SESSION_KEYS, "time_s", F.col("rainfall"), "rain_at_end").drop("time_s")
