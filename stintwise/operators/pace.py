"""Pace distributions, rankings, clean air, stops and tyre wear."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    COMPOUND_LETTERS,
    MIN_FIT_LAPS,
    PACE_CEILING,
    REFERENCE_AGE,
    SESSION_KEYS,
    WEAR_FLAG_RATIO,
)
from stintwise.functions.expressions import lookup
from stintwise.functions.skew import exact_quantiles, gap_to_best
from stintwise.operators.laps import DRIVER_KEYS, clean_air
from stintwise.operators.slopes import theil_sen
from stintwise.session import work_table

TEAM_KEYS = [*SESSION_KEYS, "constructor"]
PROBS = {"pace_ceiling_s": PACE_CEILING, "q1_s": 0.25, "median_s": 0.5, "q3_s": 0.75}


def named(laps: DataFrame, keys: list[str]) -> DataFrame:
    """Laps without a constructor as the group `?`, where constructors are the groups."""
    if "constructor" not in keys:
        return laps
    return laps.withColumn("constructor", F.coalesce("constructor", F.lit("?")))


def median_pace(paced: DataFrame, keys: list[str]) -> DataFrame:
    """Median pace, lap count and gap to the session's fastest median."""
    found = exact_quantiles(named(paced, keys), keys, "pace_s", {"median_s": 0.5}, count="n_laps")
    return gap_to_best(found, SESSION_KEYS, "median_s", "gap_s", few="driver" not in keys)


def constructor_median_gaps(paced: DataFrame) -> DataFrame:
    return median_pace(paced, TEAM_KEYS)


def fenced(paced: DataFrame, keys: list[str]) -> DataFrame:
    """Each lap with its group's quantiles and whether it lies inside the 1.5 IQR fences."""
    paced = named(paced, keys)
    stats = exact_quantiles(paced, keys, "pace_s", PROBS, count="n_laps")
    iqr = F.col("q3_s") - F.col("q1_s")
    inside = F.col("pace_s").between(
        F.col("q1_s") - F.lit(1.5) * iqr, F.col("q3_s") + F.lit(1.5) * iqr
    )
    return paced.join(stats, keys).withColumn("in_fence", inside)


def box_stats(paced: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles, whiskers, outlier counts and compounds of each group."""
    stats = [*PROBS, "n_laps"]
    kept = F.when(F.col("in_fence"), F.col("pace_s"))
    return (
        fenced(paced, keys)
        .groupBy(*keys)
        .agg(
            *[F.first(s).alias(s) for s in stats],
            F.avg("pace_s").alias("mean_s"),
            F.coalesce(F.min(kept), F.min("pace_s")).alias("whisker_low_s"),
            F.coalesce(F.max(kept), F.max("pace_s")).alias("whisker_high_s"),
            F.count_if(~F.col("in_fence")).alias("n_outliers"),
            compounds_run().alias("compounds"),
        )
    )


def outlier_laps(paced: DataFrame, keys: list[str]) -> DataFrame:
    """The laps outside the fences, one row each."""
    return fenced(paced, keys).where(~F.col("in_fence"))


def compounds_run() -> Column:
    """Known compounds of a group as letters, in the order they were first run: an aggregate of as many
    minima as there are compounds."""
    letter = lookup(COMPOUND_LETTERS, F.col("compound"))
    lap = F.struct("stint_number", "driver")

    def seen(tag: str) -> Column:
        first = F.min(F.when(letter == tag, lap))
        return F.when(first.isNotNull(), F.struct(first.alias("first"), F.lit(tag).alias("tag")))

    tags = F.array(*[seen(tag) for tag in sorted(set(COMPOUND_LETTERS.values()))])
    return F.array_join(F.transform(F.array_sort(F.array_compact(tags)), lambda s: s["tag"]), ",")


def compound_tags(laps: DataFrame, keys: list[str]) -> DataFrame:
    return laps.groupBy(*keys).agg(compounds_run().alias("compounds"))


def pace_rows(paced: DataFrame, keys: list[str]) -> DataFrame:
    """Box statistics with the gap to the session's fastest median."""
    rows = box_stats(paced, keys)
    return gap_to_best(rows, SESSION_KEYS, "median_s", "gap_s", few="driver" not in keys)


def clean_air_pace(paced: DataFrame, keys: list[str] = TEAM_KEYS) -> DataFrame:
    """Median of laps run clear of traffic, beside the plain median."""
    clear = exact_quantiles(
        named(paced, keys).where(clean_air()), keys, "pace_s", {"clean_median_s": 0.5}, count="clean_laps"
    )
    raw = median_pace(paced, keys).select(*keys, "median_s", "gap_s")
    return gap_to_best(
        clear, SESSION_KEYS, "clean_median_s", "clean_gap_s", few="driver" not in keys
    ).join(raw, keys)


def stop_counts(laps: DataFrame) -> DataFrame:
    return (
        laps.groupBy(*DRIVER_KEYS, "stint_number")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*DRIVER_KEYS)
        .agg((F.count("*") - 1).alias("stops"))
    )


def stop_spread(laps: DataFrame) -> DataFrame:
    return (
        stop_counts(laps)
        .groupBy(*SESSION_KEYS)
        .agg(
            F.when(F.count("*") < 2, F.lit(0).cast("bigint"))
            .otherwise(F.max("stops") - F.min("stops"))
            .alias("stop_spread")
        )
    )


def driver_fits(paced: DataFrame, pooled: bool = False) -> DataFrame:
    """Robust wear slope of each driver on each compound, or of the pooled team."""
    unit = [*TEAM_KEYS, "compound"] if pooled else [*TEAM_KEYS, "compound", "driver"]
    points = paced.where(F.col("tyre_age").isNotNull()).select(
        *unit, F.col("tyre_age").cast("double").alias("x"), F.col("pace_s").alias("y")
    )
    return theil_sen(points, unit, MIN_FIT_LAPS)


def degradation_fits(paced: DataFrame, pooled: bool = False) -> DataFrame:
    """Team slope per compound: the median of its drivers' slopes, flagged when it is well above
    the field's median of positive slopes on that compound."""
    keys = [*TEAM_KEYS, "compound"]
    units = work_table(driver_fits(paced, pooled), "units")  # read several times below
    teams = (
        units.groupBy(*keys)
        .agg(F.sum("n_laps").alias("n_laps"))
        .join(exact_quantiles(units, keys, "slope", {"slope_s_per_lap": 0.5}), keys)
        .join(exact_quantiles(units, keys, "intercept", {"intercept_s": 0.5}), keys)
    )
    field_keys = [*SESSION_KEYS, "compound"]
    # A field median over teams: one value per team, so the group is as small as the grid.
    field = Window.partitionBy(*field_keys)
    worn = F.when(F.col("slope_s_per_lap") > 0, F.col("slope_s_per_lap"))
    return (
        teams.withColumn("_field", F.percentile(worn, 0.5).over(field))
        .withColumn("cost_s", F.col("slope_s_per_lap") * REFERENCE_AGE)
        .withColumn(
            "flagged",
            F.coalesce(
                (F.col("_field") > 0)
                & (F.col("slope_s_per_lap") >= F.lit(WEAR_FLAG_RATIO) * F.col("_field")),
                F.lit(False),
            ),
        )
        .drop("_field")
    )


def age_range(paced: DataFrame) -> DataFrame:
    return paced.groupBy(*TEAM_KEYS).agg(
        F.min("tyre_age").alias("min_age"), F.max("tyre_age").alias("max_age")
    )


def ols_fit(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares line per group; null where x has no spread."""
    return points.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.count("*").alias("n_points"),
    )


def wear_page(paced: DataFrame, fits: DataFrame) -> DataFrame:
    """Laps by tyre age beside the fit of their team and compound, null where there is none."""
    shown = ["slope_s_per_lap", "intercept_s", "cost_s", "flagged"]
    keys = [*TEAM_KEYS, "compound"]
    laps = paced.where(F.col("tyre_age").isNotNull())
    return laps.select(*TEAM_KEYS, "driver", "lap_number", "compound", "tyre_age", "pace_s").join(
        fits.select(*keys, *shown), keys, "left"
    )
