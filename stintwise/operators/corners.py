"""Corner windows, zones, fingerprints, attribution and the constructor index."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    CORNER_GRID_POINTS,
    CORNER_HALF_WINDOW_M,
    MAX_CORNER_DELTA,
    MAX_STRAIGHT_DEFICIT,
    MAX_THROTTLE,
    MIN_CORNER_LAPS,
    PROFILE_CONFIDENCE,
    PROFILE_CORNER_KMH,
    PROFILE_STRAIGHT_KMH,
    QUALI_FULL_THROTTLE,
    REAL_STRAIGHT_KMH,
    SESSION_KEYS,
    STRAIGHT_MARGIN_M,
    TARGET_CORNER_LAPS,
    TEAMMATE_CONFIDENCE,
    UNRELIABLE_FACTOR,
    WEEKEND_KEYS,
)
from stintwise.functions.expressions import speed_class
from stintwise.functions.kernels import dtw_distance, interpolate
from stintwise.functions.skew import exact_quantiles, first_by
from stintwise.operators.telemetry import LAP
from stintwise.session import work_table

Corners = list[tuple[int, float]]
CORNER_KEYS = [*SESSION_KEYS, "corner_number"]


def window_rows(corners: Corners) -> Column:
    """Corner windows as an array literal; a repeated number keeps its window furthest along."""
    last = dict(sorted(corners, key=lambda c: c[1]))
    return F.array(
        *[
            F.struct(
                F.lit(number).alias("corner_number"),
                F.lit(at - CORNER_HALF_WINDOW_M).alias("lo_m"),
                F.lit(at + CORNER_HALF_WINDOW_M).alias("hi_m"),
            )
            for number, at in last.items()
        ]
    )


def inside(test) -> Column:
    """The lap's (distance_m, speed_kmh) samples that pass `test(distance)`."""
    return F.filter(F.arrays_zip("distance_m", "speed_kmh"), lambda s: test(s["distance_m"]))


def corner_min_speeds(laps: DataFrame, corners: Corners) -> DataFrame:
    """Lowest speed of each lap in each corner window. Runs inside the lap row: no join."""
    at = inside(lambda d: d.between(F.col("lo_m"), F.col("hi_m")))
    keep = [c for c in laps.columns if c not in ("distance_m", "speed_kmh")]
    return (
        laps.select("*", F.inline(window_rows(corners)))
        .withColumn("min_speed_kmh", F.array_min(F.transform(at, lambda s: s["speed_kmh"])))
        .where(F.col("min_speed_kmh").isNotNull())
        .select(*keep, "corner_number", "min_speed_kmh")
    )


def zone_speeds(laps: DataFrame, corners: Corners) -> DataFrame:
    """Top and trap speed between corners; zone 0 wraps the start line. Trap speed is taken at the
    sample furthest along."""
    at = sorted(d for _, d in corners)
    far = F.array_max("distance_m")
    nowhere = F.lit(-1.0)
    wraps = [(0, at[-1] + STRAIGHT_MARGIN_M, None, at[0] - STRAIGHT_MARGIN_M)]
    gaps = [
        (i, at[i - 1] + STRAIGHT_MARGIN_M, at[i] - STRAIGHT_MARGIN_M, None)
        for i in range(1, len(at))
        if at[i] - STRAIGHT_MARGIN_M > at[i - 1] + STRAIGHT_MARGIN_M
    ]
    zones = F.array(
        *[
            F.struct(
                F.lit(zone).alias("zone"),
                F.lit(lo).alias("lo_m"),
                (far if hi is None else F.lit(hi)).alias("hi_m"),
                (nowhere if start is None else F.lit(start)).alias("start_hi_m"),
            )
            for zone, lo, hi, start in wraps + gaps
        ]
    )
    found = inside(
        lambda d: d.between(F.col("lo_m"), F.col("hi_m"))
        | ((F.col("start_hi_m") > 0) & d.between(F.lit(0.0), F.col("start_hi_m")))
    )
    return (
        laps.select(*LAP, "distance_m", "speed_kmh", F.inline(zones))
        .withColumn("_in", found)
        .where(F.size("_in") > 0)
        .select(
            *LAP,
            "zone",
            F.array_max(F.transform("_in", lambda s: s["speed_kmh"])).alias("max_speed_kmh"),
            F.array_max("_in")["speed_kmh"].alias("trap_speed_kmh"),
        )
    )


def fastest(laps: DataFrame, flag: str) -> DataFrame:
    return first_by(laps.where(F.col(flag)), [*SESSION_KEYS, "driver"], "lap_time_s", "lap_id")


def full_throttle_share(throttle: Column) -> Column:
    """Share of valid samples at full throttle; readings above 100 are error codes."""
    valid = F.filter(throttle, lambda t: t <= MAX_THROTTLE)
    full = F.filter(valid, lambda t: t >= QUALI_FULL_THROTTLE)
    return F.when(F.size(valid) > 0, F.size(full) / F.size(valid)).otherwise(0.0)


def lap_character(laps: DataFrame) -> DataFrame:
    """Top and lowest speed and full-throttle share of each driver's fastest representative lap."""
    return fastest(laps, "is_representative").select(
        *LAP,
        "lap_time_s",
        F.array_max("speed_kmh").alias("top_speed_kmh"),
        F.array_min("speed_kmh").alias("min_speed_kmh"),
        full_throttle_share(F.col("throttle")).alias("full_throttle_share"),
    )


def lap_corner_speeds(laps: DataFrame, corners: Corners) -> DataFrame:
    """Corner speeds of the same laps in long form."""
    return corner_min_speeds(
        fastest(laps, "is_representative").select(*LAP, "lap_time_s", "distance_m", "speed_kmh"),
        corners,
    )


def corner_speed_map(corner_speeds: DataFrame) -> DataFrame:
    """{corner: speed} per lap; a lap has as many entries as the track has corners."""
    return corner_speeds.groupBy(*LAP).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("corner_number", "min_speed_kmh")))
        ).alias("corner_speeds")
    )


def corner_prints(laps: DataFrame, corners: Corners) -> DataFrame:
    """Mean corner speed of a driver's clean laps per compound, without outlier rejection."""
    clean = laps.where(F.col("is_clean")).select(*LAP, "compound", "distance_m", "speed_kmh")
    return (
        corner_min_speeds(clean, corners)
        .groupBy(*CORNER_KEYS, "driver", "constructor", "compound")
        .agg(F.avg("min_speed_kmh").alias("min_speed_kmh"), F.count("*").alias("clean_laps"))
    )


# --- fingerprints -----------------------------------------------------------


def corner_traces(laps: DataFrame, corners: Corners, points: int = CORNER_GRID_POINTS) -> DataFrame:
    """Each lap resampled to `points` even steps across each corner window it fully covers."""
    span = (F.col("hi_m") - F.col("lo_m")) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo_m") + i * span)
    windows = laps.select(
        *LAP,
        "compound",
        "distance_m",
        "speed_kmh",
        "throttle",
        F.col("brake").cast("array<double>").alias("brake"),
        "gear",
        F.inline(window_rows(corners)),
    ).where(
        (F.array_min("distance_m") <= F.col("lo_m")) & (F.array_max("distance_m") >= F.col("hi_m"))
    )
    traced = windows.withColumn("grid_m", grid)
    for channel in ("speed_kmh", "throttle", "brake", "gear"):
        traced = traced.withColumn(channel, interpolate("grid_m", "distance_m", channel))
    return traced.drop("distance_m", "lo_m", "hi_m")


def corner_features(traces: DataFrame) -> DataFrame:
    """Scalar signature of each trace, distances from the window start."""
    start = F.get("grid_m", F.lit(0))
    apex = (F.array_position("speed_kmh", F.array_min("speed_kmh")) - 1).cast("int")
    braking = (
        F.array_position(F.transform("brake", lambda b: b > 0.5), F.lit(True)) - 1
    ).cast("int")
    last = F.size("throttle") - 1
    on_power = F.filter(
        F.sequence(F.col("_apex"), last), lambda k: F.get("throttle", k) > F.lit(20.0)
    )
    power_at = F.get("grid_m", F.col("_power"))
    remaining = F.element_at("grid_m", -1) - power_at
    has_power = F.col("_power").isNotNull() & (F.col("_power") < last)
    return (
        traces.withColumn("_apex", apex)
        .withColumn("_brake", F.when(braking >= 0, braking))
        .withColumn("_power", F.get(on_power, F.lit(0)))
        .withColumn("min_speed_kmh", F.array_min("speed_kmh"))
        .withColumn("brake_point_m", F.get("grid_m", F.col("_brake")) - start)
        .withColumn(
            "trail_brake_m",
            F.when(
                F.col("_brake") <= F.col("_apex"),
                F.get("grid_m", F.col("_apex")) - F.get("grid_m", F.col("_brake")),
            ).when(F.col("_brake").isNotNull(), F.lit(0.0)),
        )
        .withColumn("throttle_point_m", F.when(has_power, power_at - start))
        .withColumn(
            "throttle_ramp",
            F.when(
                has_power & (remaining > 0),
                (F.element_at("throttle", -1) - F.get("throttle", F.col("_power"))) / remaining,
            ),
        )
        .withColumn("gear", F.bround(F.get("gear", F.col("_apex"))).cast("int"))
        .drop("_apex", "_brake", "_power")
    )


FEATURES = ["min_speed_kmh", "brake_point_m", "trail_brake_m", "throttle_point_m", "throttle_ramp"]


def feature_mean(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(
        *[F.avg(f).alias(f) for f in FEATURES],
        F.bround(F.avg("gear")).cast("int").alias("gear"),
        F.count("*").alias("clean_laps"),
    )


def fingerprints(laps: DataFrame, corners: Corners, outlier_ratio: float = 2.0) -> DataFrame:
    """Mean corner signature per driver and compound, after dropping laps whose trace is far from
    the group's median trace by warped distance."""
    keys = [*CORNER_KEYS, "driver", "constructor", "compound"]
    known = laps.withColumn("compound", F.coalesce("compound", F.lit("UNKNOWN")))
    featured = corner_features(corner_traces(known.where(F.col("is_clean")), corners))
    # Resampled once: the median trace and the features both come from this copy.
    traces = work_table(
        featured.select(*keys, "speed_kmh", *FEATURES, "gear"), "traces"
    )
    points = traces.select(*keys, F.posexplode("speed_kmh").alias("k", "kmh"))
    medians = exact_quantiles(points, [*keys, "k"], "kmh", {"kmh": 0.5})
    reference = medians.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("k", "kmh"))), lambda p: p["kmh"]
        ).alias("_ref")
    )
    measured = traces.join(reference, keys).withColumn(
        "_dtw", dtw_distance("speed_kmh", "_ref")
    )
    typical = exact_quantiles(measured, keys, "_dtw", {"_mid": 0.5})
    near = (F.col("_mid") == 0) | (F.col("_dtw") <= F.lit(outlier_ratio) * F.col("_mid"))
    return feature_mean(measured.join(typical, keys).where(near), keys)


# --- attribution ------------------------------------------------------------


def confidence(laps: Column) -> Column:
    return F.least(F.lit(1.0), laps / TARGET_CORNER_LAPS)


def driver_corners(prints: DataFrame) -> DataFrame:
    """Lap-weighted corner speed of a driver over compounds with enough laps."""
    return (
        prints.where(
            F.col("min_speed_kmh").isNotNull()
            & (F.col("clean_laps") >= MIN_CORNER_LAPS)
            & F.col("constructor").isNotNull()
        )
        .groupBy(*CORNER_KEYS, "constructor", "driver")
        .agg(
            (F.sum(F.col("min_speed_kmh") * F.col("clean_laps")) / F.sum("clean_laps")).alias(
                "metric"
            ),
            F.sum("clean_laps").alias("laps"),
        )
    )


def team_corners(prints: DataFrame) -> DataFrame:
    two = F.count("*") >= 2
    return (
        driver_corners(prints)
        .groupBy(*CORNER_KEYS, "constructor")
        .agg(
            F.avg("metric").alias("car_kmh"),
            F.when(two, F.max("metric") - F.min("metric")).alias("spread"),
            F.min("laps").alias("min_laps"),
            (two & (F.min(confidence(F.col("laps"))) >= TEAMMATE_CONFIDENCE)).alias("reliable"),
        )
    )


def attribution(prints: DataFrame) -> DataFrame:
    """Speed gap of every two constructors at a corner, split into car and driver. Rows are teams by
    now, so the pairs are those of the grid, whatever the number of laps."""
    teams = team_corners(prints)
    a = teams.select(*CORNER_KEYS, *[F.col(c).alias(f"a_{c}") for c in teams.columns[4:]])
    b = teams.select(*CORNER_KEYS, *[F.col(c).alias(f"b_{c}") for c in teams.columns[4:]])
    pair = a.join(b, CORNER_KEYS).where(F.col("a_constructor") < F.col("b_constructor"))
    spread = F.coalesce(
        (F.col("a_spread") + F.col("b_spread")) / 2, "a_spread", "b_spread", F.lit(0.0)
    )
    gap = F.abs("delta_kmh")
    car = F.when(gap + F.col("_spread") > 0, gap / (gap + F.col("_spread"))).otherwise(1.0)
    thin = confidence(F.least("a_min_laps", "b_min_laps"))
    return (
        pair.withColumn("delta_kmh", F.col("a_car_kmh") - F.col("b_car_kmh"))
        .withColumn("_spread", spread)
        .select(
            *CORNER_KEYS,
            F.col("a_constructor").alias("constructor_a"),
            F.col("b_constructor").alias("constructor_b"),
            "delta_kmh",
            speed_class((F.col("a_car_kmh") + F.col("b_car_kmh")) / 2).alias("speed_class"),
            car.alias("car_pct"),
            (F.lit(1.0) - car).alias("driver_pct"),
            (
                thin
                * F.when(F.col("a_reliable") & F.col("b_reliable"), F.lit(1.0)).otherwise(
                    UNRELIABLE_FACTOR
                )
            ).alias("confidence"),
        )
    )


def corner_advantages(prints: DataFrame) -> DataFrame:
    """Each constructor's speed against the corner's field mean, where there is a field."""
    field = Window.partitionBy(*CORNER_KEYS)
    return (
        team_corners(prints)
        .withColumn("_field", F.avg("car_kmh").over(field))
        .withColumn("_teams", F.count("*").over(field))
        .where(F.col("_teams") >= 2)
        .select(
            *CORNER_KEYS,
            "constructor",
            speed_class(F.col("_field")).alias("speed_class"),
            (F.col("car_kmh") - F.col("_field")).alias("advantage_kmh"),
            confidence(F.col("min_laps")).alias("confidence"),
        )
    )


def constructor_index(prints: DataFrame, race_pace: DataFrame) -> DataFrame:
    """Confidence-weighted corner advantage by speed class, ranked by race pace; teams without a
    race come last."""
    weight = F.col("confidence")

    def band(test: Column | None, name: str) -> Column:
        w = weight if test is None else F.when(test, weight)
        return (F.sum(F.col("advantage_kmh") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(name)

    scores = (
        corner_advantages(prints)
        .groupBy(*WEEKEND_KEYS, "constructor")
        .agg(
            *[band(F.col("speed_class") == c, f"{c}_score") for c in ("high", "mid", "low")],
            band(None, "overall_score"),
        )
    )
    deficits = race_pace.select(*WEEKEND_KEYS, "constructor", F.col("gap_s").alias("lap_deficit_s"))
    weekend = Window.partitionBy(*WEEKEND_KEYS).orderBy(
        F.asc_nulls_last("lap_deficit_s"), "constructor"
    )
    return scores.join(deficits, [*WEEKEND_KEYS, "constructor"], "full").withColumn(
        "overall_rank", F.row_number().over(weekend)
    )


def quality_report(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clean laps per constructor and corner with constructor totals, and the mean confidence of the
    constructor's attributions on the total row."""
    counts = (
        prints.groupBy(*WEEKEND_KEYS, "constructor", "corner_number")
        .agg(F.sum("clean_laps").alias("clean_laps"))
        .rollup(*WEEKEND_KEYS, "constructor", "corner_number")
        .agg(F.sum("clean_laps").alias("clean_laps"), F.count("corner_number").alias("corners"))
        .where(F.col("constructor").isNotNull())
    )
    sides = pairs.select(
        *WEEKEND_KEYS,
        F.explode(F.array("constructor_a", "constructor_b")).alias("constructor"),
        "confidence",
    )
    trust = (
        sides.groupBy(*WEEKEND_KEYS, "constructor")
        .agg(F.avg("confidence").alias("mean_confidence"))
        .withColumn("corner_number", F.lit(None).cast("int"))
    )
    total = F.col("corner_number").isNull()
    return (
        counts.join(trust.drop("corner_number"), [*WEEKEND_KEYS, "constructor"], "left")
        .withColumn("mean_confidence", F.when(total, F.col("mean_confidence")))
        .withColumn("corners", F.when(total, F.col("corners")))
    )


def corner_delta_lookup(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """A pair's attributions in either order, positive when `a` is faster."""
    sign = F.when(F.col("constructor_a") == a, 1.0).otherwise(-1.0)
    return pairs.where(F.col("constructor_a").isin(a, b) & F.col("constructor_b").isin(a, b)).select(
        *CORNER_KEYS,
        "speed_class",
        (F.coalesce("delta_kmh", F.lit(0.0)) * sign).alias("delta_kmh"),
        "car_pct",
        "driver_pct",
        "confidence",
    )


CHANNELS = ["cornering_kmh", "top_speed_kmh", "sector_s"]


def speed_profile(
    sessions: DataFrame, pairs: DataFrame, zones: DataFrame, sectors: DataFrame, a: str, b: str
) -> DataFrame:
    """Where two cars differ, one row per reading: corners by speed class with the corners that count,
    top speed and sectors. Doubtful and implausible readings are left out. Every session has rows for all
    channels: one without readings has one row without an item. `confident` tells whether the session
    has any reading."""
    trusted = corner_delta_lookup(pairs, a, b).where(
        (F.col("confidence") >= PROFILE_CONFIDENCE) & (F.abs("delta_kmh") <= PROFILE_CORNER_KMH)
    )
    kind = F.coalesce("speed_class", F.lit("unclassified"))
    cornering = trusted.groupBy(*SESSION_KEYS, kind.alias("item")).agg(
        F.lit(CHANNELS[0]).alias("channel"),
        F.avg("delta_kmh").alias("delta"),
        F.array_join(F.array_sort(F.collect_list("corner_number")), ",").alias("corner_numbers"),
        F.count("*").alias("n_corners"),
    )

    def difference(rows: DataFrame, value: Column, item: Column, channel: str) -> DataFrame:
        def of(team: str) -> Column:
            return F.when(F.col("constructor") == team, value)

        return (
            rows.where(F.col("constructor").isin(a, b))
            .groupBy(*SESSION_KEYS, item.alias("item"))
            .agg(
                F.lit(channel).alias("channel"),
                (F.max(of(a)) - F.max(of(b))).alias("delta")
                if channel == "top_speed_kmh"
                else (F.min(of(a)) - F.min(of(b))).alias("delta"),
                F.lit("").alias("corner_numbers"),
                F.lit(0).cast("bigint").alias("n_corners"),
            )
            .where(F.col("delta").isNotNull())
        )

    top = difference(zones, F.col("max_speed_kmh"), F.lit("lap"), CHANNELS[1]).where(
        F.abs("delta") <= PROFILE_STRAIGHT_KMH
    )
    by_sector = difference(
        sectors, F.col("best_time_s"), F.col("sector").cast("string"), CHANNELS[2]
    )
    readings = cornering.unionByName(top).unionByName(by_sector)
    every = sessions.select(*SESSION_KEYS, F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))
    session = Window.partitionBy(*SESSION_KEYS)  # a dozen rows
    return (
        every.join(readings, [*SESSION_KEYS, "channel"], "left")
        .withColumn("confident", F.count("delta").over(session) > 0)
        .withColumn("delta", F.bround("delta", 3))
        .withColumn("corner_numbers", F.coalesce("corner_numbers", F.lit("")))
        .withColumn("n_corners", F.coalesce("n_corners", F.lit(0).cast("bigint")))
        .select(*SESSION_KEYS, "channel", "item", "delta", "corner_numbers", "n_corners", "confident")
    )


def corner_caps(pairs: DataFrame) -> DataFrame:
    """Corner readings of two cars with what the caps say of them: `plausible` for findings, `profiled`
    for the comparison of two cars, which asks for more."""
    off = F.abs("delta_kmh")
    known = F.col("delta_kmh").isNotNull() & F.col("confidence").isNotNull()
    return pairs.select(
        *SESSION_KEYS,
        "corner_number",
        "constructor_a",
        "constructor_b",
        "delta_kmh",
        F.coalesce(known & (off <= MAX_CORNER_DELTA), F.lit(False)).alias("plausible"),
        F.coalesce(
            (F.col("confidence") >= PROFILE_CONFIDENCE) & (off <= PROFILE_CORNER_KMH), F.lit(False)
        ).alias("profiled"),
    )


def straight_caps(zones: DataFrame) -> DataFrame:
    """Teams' speeds on a straight with their deficit to the fastest and whether the caps let it count: a
    real straight, a deficit, and none too great."""
    field = Window.partitionBy(*SESSION_KEYS, "zone")
    teams = (
        zones.where(F.col("constructor").isNotNull() & F.col("max_speed_kmh").isNotNull())
        .groupBy(*SESSION_KEYS, "zone", "constructor")
        .agg(F.avg("max_speed_kmh").alias("kmh"))
        .withColumn("fastest_kmh", F.max("kmh").over(field))
    )
    deficit = F.col("fastest_kmh") - F.col("kmh")
    return teams.withColumn("deficit_kmh", deficit).withColumn(
        "plausible",
        (F.col("fastest_kmh") >= REAL_STRAIGHT_KMH) & (deficit > 0) & (deficit <= MAX_STRAIGHT_DEFICIT),
    )
