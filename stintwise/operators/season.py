"""Season rollups. Inputs are one row per round and team; groups are as small as the calendar."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    CIRCUIT_KM,
    HALF_LIFE_ROUNDS,
    HARVEST_BAND,
    HOLD_LO,
    KMH_TO_MPH,
    MIN_BAND_BINS,
    MIN_BAND_POINTS,
    MIN_BIN_SAMPLES,
    POWER_UNITS,
    PUNCH_LO,
    QUALI_WEIGHT,
    RACE_WEIGHT,
    SCATTER_POINTS,
    SESSION_KEYS,
    SPEED_BIN_KMH,
    WEEKEND_KEYS,
)
from stintwise.functions.expressions import lookup
from stintwise.functions.skew import attach, exact_quantiles, row_numbers
from stintwise.functions.text_rules import VERDICT_NONE, VERDICTS
from stintwise.operators.catalog import pick_session
from stintwise.operators.quali import fastest_per_constructor, sector_dominance

SEASON_TEAM = ["year", "constructor"]


def metric_mean_spread(values: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Mean, population spread and count of `value` per team; with `current` rounds the mean weighs
    recent rounds more."""
    if current is None:
        mean = F.avg("value")
    else:
        values = values.join(current, "year")
        age = (F.col("current_round") - F.col("round")) / F.lit(HALF_LIFE_ROUNDS)
        weight = F.pow(F.lit(0.5), age)
        mean = F.sum(weight * F.col("value")) / F.sum(weight)
    return values.groupBy(*SEASON_TEAM).agg(
        mean.alias("mean"), F.stddev_pop("value").alias("spread"), F.count("value").alias("n")
    )


def round_sums(values: DataFrame) -> DataFrame:
    """(year, round, constructor, n, mean, m2): what one round adds to a team's season. Rounds can be
    replaced one by one; a season's mean and spread follow from these rows alone."""
    return values.groupBy("year", "round", "constructor").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"),
    )


def season_of_rounds(sums: DataFrame) -> DataFrame:
    """(year, constructor, mean, spread, n, recent_mean) of a season from its rounds' sums: the plain mean
    and population spread, and the mean that halves a round's weight every `HALF_LIFE_ROUNDS` rounds
    before the season's last. A team has a row a round."""
    last = F.max("round").over(Window.partitionBy("year"))
    team = Window.partitionBy(*SEASON_TEAM)
    middle = F.sum(F.col("n") * F.col("mean")).over(team) / F.sum("n").over(team)
    weight = F.col("n") * F.pow(F.lit(0.5), (F.col("_last") - F.col("round")) / F.lit(HALF_LIFE_ROUNDS))
    within = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_middle"), 2)
    return (
        sums.withColumn("_last", last)
        .where("n > 0")
        .withColumn("_middle", middle)
        .groupBy(*SEASON_TEAM)
        .agg(
            F.first("_middle").alias("mean"),
            F.sqrt(F.sum(within) / F.sum("n")).alias("spread"),
            F.sum("n").alias("n"),
            (F.sum(weight * F.col("mean")) / F.sum(weight)).alias("recent_mean"),
        )
    )


def normalized(value: str, keys: list[str]) -> Column:
    """0 for the smallest, 1 for the largest; 0 throughout without spread; null stays null."""
    group = Window.partitionBy(*keys)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(F.col(value).isNotNull() & (high == low), F.lit(0.0)).otherwise(
        (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))
    )


def overall_ranking(pace: DataFrame, quali: DataFrame, keys: list[str]) -> DataFrame:
    """Blend of both normalised deficits, or the one a team has, ranked from the lowest."""
    joined = pace.join(quali, [*keys, "constructor"], "full")
    p, q = F.col("_pace"), F.col("_quali")
    score = F.coalesce(F.lit(RACE_WEIGHT) * p + F.lit(QUALI_WEIGHT) * q, p, q)
    order = Window.partitionBy(*keys).orderBy("score", "constructor")
    return (
        joined.withColumn("_pace", normalized("pace", keys))
        .withColumn("_quali", normalized("quali", keys))
        .withColumn("score", score)
        .where(F.col("score").isNotNull())
        .withColumn("overall_rank", F.row_number().over(order))
        .select(*keys, "constructor", "score", "overall_rank")
    )


def quali_metrics(quali_rows: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Qualifying gap in percent and top-speed deficit of each team per weekend."""
    picked = quali_rows.join(pick_session(sessions, ["Q", "SQ"]), SESSION_KEYS)
    field = Window.partitionBy(*SESSION_KEYS)
    best = F.min("lap_time_s").over(field)
    gaps = fastest_per_constructor(picked).select(
        *WEEKEND_KEYS,
        "constructor",
        ((F.col("lap_time_s") - best) / best * 100.0).alias("value"),
    )
    tops = picked.groupBy(*SESSION_KEYS, "constructor").agg(F.max("top_speed_kmh").alias("_top"))
    deficits = tops.select(
        *WEEKEND_KEYS, "constructor", (F.max("_top").over(field) - F.col("_top")).alias("value")
    )
    return gaps, deficits


def reference_wear(wear: DataFrame) -> DataFrame:
    """Median slope on the season's most-run compound, or over all compounds for a team without it.
    A team has one fit per round and compound."""
    most_run = (
        wear.groupBy("year", "compound")
        .agg(F.sum("n_laps").alias("_laps"))
        .groupBy("year")
        .agg(F.min_by("compound", F.struct(-F.col("_laps"), F.col("compound"))).alias("_ref"))
    )
    slope = F.col("slope_s_per_lap")
    on_ref = F.when(F.col("compound") == F.col("_ref"), slope)
    return (
        wear.join(most_run, "year")
        .groupBy(*SEASON_TEAM)
        .agg(
            F.coalesce(F.percentile(on_ref, 0.5), F.percentile(slope, 0.5)).alias(
                "tyre_deg_s_per_lap"
            )
        )
    )


def season_trends(race_pace: DataFrame, quali_gaps: DataFrame) -> DataFrame:
    """(year, round, constructor, metric, value) for pace, quali and the blended score."""
    pace = race_pace.select(*WEEKEND_KEYS, "constructor", F.col("gap_s").alias("value"))
    blend = overall_ranking(
        pace.withColumnRenamed("value", "pace"),
        quali_gaps.withColumnRenamed("value", "quali"),
        WEEKEND_KEYS,
    ).select(*WEEKEND_KEYS, "constructor", F.col("score").alias("value"))
    return (
        pace.withColumn("metric", F.lit("pace"))
        .unionByName(quali_gaps.withColumn("metric", F.lit("quali")))
        .unionByName(blend.withColumn("metric", F.lit("cumulative")))
    )


def season_snapshot(
    sessions: DataFrame,
    race_pace: DataFrame,
    quali_rows: DataFrame,
    sector_bests: DataFrame,
    wear: DataFrame,
    max_round: int | None = None,
) -> DataFrame:
    """One row per year and constructor over all weekends, or those up to `max_round`."""
    if max_round is not None:
        upto = lambda df: df.where(F.col("round") <= max_round)
        sessions, race_pace, quali_rows = upto(sessions), upto(race_pace), upto(quali_rows)
        sector_bests, wear = upto(sector_bests), upto(wear)
    calendar = sessions.groupBy("year").agg(
        F.max("round").alias("current_round"), F.count_distinct("round").alias("_rounds")
    )
    current = calendar.select("year", "current_round")
    pace = race_pace.select(*WEEKEND_KEYS, "constructor", F.col("gap_s").alias("value"))
    quali, tops = quali_metrics(quali_rows, sessions)
    picked = pick_session(sessions, ["Q", "SQ"])
    sectors = (
        sector_dominance(sector_bests.join(picked, SESSION_KEYS), SESSION_KEYS)
        .groupBy(*SEASON_TEAM)
        .agg(F.count("*").alias("sector_dominance_count"))
    )

    def renamed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*SEASON_TEAM, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns[2:]])

    pace_agg = renamed(metric_mean_spread(pace, current), "pace")
    quali_agg = renamed(metric_mean_spread(quali, current), "quali")
    top_agg = metric_mean_spread(tops).select(
        *SEASON_TEAM, F.col("mean").alias("top_speed_deficit_kmh")
    )
    ranks = overall_ranking(
        pace_agg.select(*SEASON_TEAM, F.col("pace_mean").alias("pace")),
        quali_agg.select(*SEASON_TEAM, F.col("quali_mean").alias("quali")),
        ["year"],
    )
    seen = (
        pace.unionByName(quali).groupBy(*SEASON_TEAM).agg(F.count_distinct("round").alias("_seen"))
    )
    rows = pace_agg
    for part in (quali_agg, top_agg, sectors, reference_wear(wear), seen):
        rows = rows.join(part, SEASON_TEAM, "full")
    share = F.coalesce("_seen", F.lit(0)) / F.col("_rounds")
    return (
        rows.join(ranks.drop("score"), SEASON_TEAM, "left")
        .join(calendar.drop("current_round"), "year")
        .withColumn(
            "confidence",
            F.when(share >= 0.75, "high").when(share >= 0.4, "med").otherwise("low"),
        )
        .withColumn("sector_dominance_count", F.coalesce("sector_dominance_count", F.lit(0)))
        .withColumn("top_speed_deficit_mph", F.col("top_speed_deficit_kmh") * F.lit(KMH_TO_MPH))
        .withColumn("pace_n", F.coalesce("pace_n", F.lit(0)))
        .withColumn("quali_n", F.coalesce("quali_n", F.lit(0)))
        .drop("_seen", "_rounds")
    )


def season_totals(paced: DataFrame, calendar: DataFrame) -> DataFrame:
    """Kept laps of each year and the kilometres they cover on circuits of known length."""
    laps = paced.groupBy(*WEEKEND_KEYS).agg(F.count("*").alias("_laps"))
    km = lookup(CIRCUIT_KM, F.col("location"))
    return (
        laps.join(calendar.select(*WEEKEND_KEYS, "location"), WEEKEND_KEYS)
        .groupBy("year")
        .agg(
            F.sum("_laps").alias("total_laps"),
            F.bround(F.sum(F.coalesce(F.col("_laps") * km, F.lit(0.0))), 1).alias("total_km"),
        )
    )


# --- power units ------------------------------------------------------------


def supply_map(units: dict[str, list[str]] = POWER_UNITS) -> dict[str, str]:
    return {team: unit for unit, teams in units.items() for team in teams}


def pool_by_group(points: DataFrame, units: dict[str, list[str]] = POWER_UNITS) -> DataFrame:
    return points.withColumn("unit", lookup(supply_map(units), F.col("constructor"))).where(
        F.col("unit").isNotNull()
    )


def speed_bins(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median acceleration per speed bin."""
    floor = F.floor(F.col("speed_kmh") / SPEED_BIN_KMH) * F.lit(SPEED_BIN_KMH)
    binned = points.withColumn("speed_mid_kmh", floor + F.lit(SPEED_BIN_KMH / 2))
    return exact_quantiles(
        binned, [*keys, "speed_mid_kmh"], "accel_ms2", {"median_accel": 0.5}, "n_samples"
    )


def pu_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Punch, hold and fade of each group. A group has a few dozen speed bins."""
    bins = speed_bins(points, keys).where(F.col("n_samples") >= MIN_BIN_SAMPLES)
    mid = F.col("speed_mid_kmh")

    def band(test: Column) -> Column:
        value = F.when(test, F.col("median_accel"))
        return F.when(F.count(value) >= MIN_BAND_BINS, F.percentile(value, 0.5))

    measured = bins.groupBy(*keys).agg(
        band((mid >= PUNCH_LO) & (mid < HOLD_LO)).alias("punch"),
        band(mid >= HOLD_LO).alias("hold"),
    )
    present = points.groupBy(*keys).agg(F.count("*").alias("n_points"))
    return present.join(measured, keys, "left").withColumn("fade", F.col("punch") - F.col("hold"))


def pu_ranking(points: DataFrame, units: dict[str, list[str]] = POWER_UNITS) -> DataFrame:
    """Power units ranked by the mean of punch and hold, or the one measured; unmeasured last."""
    rows = pu_metrics(pool_by_group(points, units), ["year", "unit"])
    score = F.coalesce((F.col("punch") + F.col("hold")) / 2, "punch", "hold")
    order = Window.partitionBy("year").orderBy(F.desc_nulls_last("score"), "unit")
    return rows.withColumn("score", score).withColumn("pu_rank", F.row_number().over(order))


def pu_verdict_rank(metrics: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """The one or two most telling places of each unit: first or last beats second, then metric
    order. A metric counts only with three units and real spread."""
    def reading(metric: str, order: int, by: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(order).alias("metric_order"),
            F.col(metric).alias("value"),
            by.alias("_by"),
        )

    readings = F.array(
        reading("punch", 0, -F.col("punch")),
        reading("hold", 1, -F.col("hold")),
        reading("fade", 2, F.col("fade") * 1.0),
    )
    long = metrics.select("year", "unit", F.inline(readings)).where(F.col("value").isNotNull())
    field = Window.partitionBy("year", "metric")
    ranked = (
        long.withColumn("total", F.count("*").over(field))
        .withColumn("_spread", F.max("value").over(field) - F.min("value").over(field))
        .where((F.col("total") >= 3) & (F.col("_spread") >= epsilon))
        .withColumn("place", F.row_number().over(field.orderBy("_by", "unit")))
    )
    extremity = F.when(
        (F.col("place") == 1) | (F.col("place") == F.col("total")), 1.0
    ).when((F.col("place") == 2) & (F.col("metric") != "fade"), 0.5)
    picks = Window.partitionBy("year", "unit").orderBy(F.desc("extremity"), "metric_order")
    return (
        ranked.withColumn("extremity", extremity)
        .where(F.col("extremity").isNotNull())
        .withColumn("pick", F.row_number().over(picks))
        .where(F.col("pick") <= 2)
        .select(
            "year",
            "unit",
            "metric",
            "value",
            "place",
            "total",
            "extremity",
            "pick",
            F.format_string("%s %d of %d (%+.1f)", "metric", "place", "total", "value").alias(
                "clause"
            ),
        )
    )


def signed(metric: str) -> Column:
    return F.format_string("%+.1f", F.col(metric) + F.lit(0.0))


def pu_verdicts(metrics: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """(year, unit, place, header, explanation): one verdict for every measured unit, best first by punch,
    then hold. It tells the unit's one or two most telling places, or that it has none; a year in which
    no metric tells units apart has no verdicts."""
    picks = pu_verdict_rank(metrics, epsilon)
    place = (
        F.when(F.col("place") == 1, "first").when(F.col("place") == F.col("total"), "last").otherwise("second")
    )
    # of a fade as of other metrics the greatest is "last"; with a hold at or below nothing it runs dry
    dry = (F.col("metric") == "hold") & (place == "last") & (F.col("hold") <= 0)
    key = F.concat_ws(" ", "metric", F.when(dry, "dry").otherwise(place))
    said = picks.join(metrics.select("year", "unit", "punch", "hold"), ["year", "unit"]).select(
        "year",
        "unit",
        "pick",
        lookup({k: v[0] for k, v in VERDICTS.items()}, key).alias("headline"),
        F.replace(
            F.replace(lookup({k: v[1] for k, v in VERDICTS.items()}, key), F.lit("{punch}"), F.coalesce(signed("punch"), F.lit(""))),
            F.lit("{hold}"),
            F.coalesce(signed("hold"), F.lit("")),
        ).alias("clause"),
    )
    told = said.groupBy("year", "unit").agg(
        F.min_by("headline", "pick").alias("headline"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", "clause"))), lambda s: s["clause"]), "; ").alias("_told"),
    )
    told_at_all = picks.select("year").distinct()  # the first and the last of a metric are always picked
    best = Window.partitionBy("year").orderBy(F.desc_nulls_last("punch"), F.desc_nulls_last("hold"), "unit")
    upper = F.concat(F.upper(F.substring("_told", 1, 1)), F.expr("substring(_told, 2)"), F.lit("."))
    return (
        metrics.where("punch is not null or hold is not null")
        .join(told_at_all, "year", "left_semi")
        .withColumn("place", F.row_number().over(best))
        .join(told, ["year", "unit"], "left")
        .select(
            "year",
            "unit",
            "place",
            F.concat("unit", F.lit(" power "), F.coalesce("headline", F.lit(VERDICT_NONE[0]))).alias("header"),
            F.coalesce(upper, F.lit(VERDICT_NONE[1])).alias("explanation"),
        )
    )


def band_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of acceleration on speed inside the harvesting band, with enough points."""
    low, high = HARVEST_BAND
    return (
        points.where(F.col("speed_kmh").between(low, high) & F.col("constructor").isNotNull())
        .groupBy(*keys)
        .agg(
            F.regr_slope("accel_ms2", "speed_kmh").alias("slope"),
            F.regr_intercept("accel_ms2", "speed_kmh").alias("intercept"),
            F.count("*").alias("n_points"),
        )
        .where((F.col("n_points") >= MIN_BAND_POINTS) & F.col("slope").isNotNull())
    )


def race_deployment_character(points: DataFrame) -> DataFrame:
    """Fitted acceleration at both ends of the band, field means, and rank by the upper end."""
    low, high = HARVEST_BAND
    field = Window.partitionBy(*WEEKEND_KEYS)
    fits = band_fit(points, [*WEEKEND_KEYS, "constructor"])
    return (
        fits.withColumn("accel_at_150_ms2", F.col("slope") * low + F.col("intercept"))
        .withColumn("accel_at_250_ms2", F.col("slope") * high + F.col("intercept"))
        .withColumn("field_at_150_ms2", F.avg("accel_at_150_ms2").over(field))
        .withColumn("field_at_250_ms2", F.avg("accel_at_250_ms2").over(field))
        .withColumn("n_constructors", F.count("*").over(field))
        .withColumn(
            "place",
            F.row_number().over(field.orderBy(F.desc("accel_at_250_ms2"), "constructor")),
        )
        .where(F.col("n_constructors") >= 3)
        .drop("intercept")
    )


def accel_scatter(points: DataFrame, budget: int = SCATTER_POINTS) -> DataFrame:
    """Every k-th sample of a team's season in order, k the smallest stride within `budget`."""
    order = [F.col(c) for c in ("round", "driver", "lap_id", "sample_idx")]
    numbered = row_numbers(points, SEASON_TEAM, order, "_n")
    stride = F.ceil(F.col("_total") / budget)
    return (
        attach(numbered, SEASON_TEAM, F.count("*").alias("_total"))
        .where((F.col("_n") - 1) % stride == 0)
        .drop("_n", "_total")
    )


# --- trends for charts ------------------------------------------------------


def trend_gap_fill(trends: DataFrame, rounds: DataFrame) -> DataFrame:
    """Each team's trend on every round: exact, interpolated between neighbours, or held flat."""
    keys = ["year", "constructor", "metric"]
    teams = trends.select(*keys).distinct()
    spine = teams.join(rounds.select(*WEEKEND_KEYS).distinct(), "year")
    team = Window.partitionBy(*keys).orderBy("round")
    back = team.rowsBetween(Window.unboundedPreceding, -1)
    ahead = team.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("round", "value"))
    rows = (
        spine.join(trends, [*keys, "round"], "left")
        .withColumn("_known", known)
        .withColumn("_before", F.last("_known", ignorenulls=True).over(back))
        .withColumn("_after", F.first("_known", ignorenulls=True).over(ahead))
    )
    share = (F.col("round") - F.col("_before.round")) / (
        F.col("_after.round") - F.col("_before.round")
    )
    between = F.col("_before.value") + (F.col("_after.value") - F.col("_before.value")) * share
    return rows.select(
        *keys,
        "round",
        F.coalesce("value", between, "_before.value", "_after.value", F.lit(0.0)).alias("value"),
        F.col("value").isNotNull().alias("measured"),
    )


def trend_legend_order(trends: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Team order per metric: by season mean, or by the latest value for the blended score."""
    latest = trends.groupBy("year", "constructor", "metric").agg(
        F.max_by("value", "round").alias("_latest")
    )
    means = snapshot.select(*SEASON_TEAM, "pace_mean", "quali_mean")
    by = (
        F.when(F.col("metric") == "pace", F.col("pace_mean"))
        .when(F.col("metric") == "quali", F.col("quali_mean"))
        .otherwise(F.col("_latest"))
    )
    order = Window.partitionBy("year", "metric").orderBy(F.asc_nulls_last("sort_value"), "constructor")
    return (
        latest.join(means, SEASON_TEAM, "left")
        .withColumn("sort_value", by)
        .withColumn("legend_rank", F.row_number().over(order))
        .select("year", "constructor", "metric", "sort_value", "legend_rank")
    )


def wear_legend(fits: DataFrame) -> DataFrame:
    """Per compound: teams that ran it, worst wear first, then the others by name."""
    teams = fits.select(*SESSION_KEYS, "constructor").distinct()
    compounds = fits.select(*SESSION_KEYS, "compound").distinct()
    spine = teams.join(compounds, SESSION_KEYS)
    order = Window.partitionBy(*SESSION_KEYS, "compound").orderBy(
        F.desc_nulls_last("slope_s_per_lap"), "constructor"
    )
    return (
        spine.join(
            fits.select(*SESSION_KEYS, "constructor", "compound", "slope_s_per_lap"),
            [*SESSION_KEYS, "constructor", "compound"],
            "left",
        )
        .withColumn("legend_rank", F.row_number().over(order))
        .withColumn(
            "label",
            F.when(
                F.col("slope_s_per_lap").isNotNull(),
                F.format_string("%+.3fs/lap", "slope_s_per_lap"),
            ).otherwise("not run"),
        )
    )
