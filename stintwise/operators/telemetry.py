"""Ordered-sample operators. A lap is one row of sample arrays."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    CLIP_DROP_KMH,
    CLIP_SPEED_KMH,
    CLIP_TOP_SHARE,
    DEPLETION_MS2,
    FULL_THROTTLE,
    GRID_STEP_M,
    MAX_LATERAL_MS2,
    MAX_LENGTH_DEVIATION_M,
    MAX_LONGITUDINAL_MS2,
    MAX_RESIDUAL_MS2,
    MIN_CLIP_M,
    MIN_CLIP_SAMPLES,
    MIN_RISING_SAMPLES,
    MIN_STRAIGHT_M,
    MIN_STRAIGHT_TOP_KMH,
    RISING_SPEED_KMH,
    SESSION_KEYS,
    SUPERCLIP_GATE_MS2,
    SUPERCLIP_RESIDUAL_MS2,
)
from stintwise.functions.kernels import interpolate, lateral_accel, longitudinal_accel, lowpass
from stintwise.functions.skew import exact_quantiles, first_by
from stintwise.operators.laps import fastest_laps_per_driver
from stintwise.session import work_table

LAP = [*SESSION_KEYS, "driver", "constructor", "lap_id"]


def samples(laps: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """Lap arrays as one row per sample with a 1-based `sample_idx`."""
    return laps.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("_i", "_s")).select(
        *keys, (F.col("_i") + 1).alias("sample_idx"), "_s.*"
    )


def gradient(values: Column, times: Column) -> Column:
    """Derivative on an uneven clock: second order inside, one-sided at the ends."""
    last = F.size(values) - 1

    def at(x: Column, i: Column) -> Column:
        here, back, ahead = x, F.get(values, i - 1), F.get(values, i + 1)
        hs = F.get(times, i) - F.get(times, i - 1)
        hd = F.get(times, i + 1) - F.get(times, i)
        inner = (hs * hs * ahead + (hd * hd - hs * hs) * here - hd * hd * back) / (
            hs * hd * (hs + hd)
        )
        return (
            F.when(last < 1, F.lit(0.0))
            .when(i == 0, (ahead - here) / hd)
            .when(i == last, (here - back) / hs)
            .otherwise(inner)
        )

    return F.transform(values, at)


def lap_relative_time(times: Column) -> Column:
    return F.transform(times, lambda t: t - F.get(times, F.lit(0)))


def time_from_distance(laps: DataFrame) -> DataFrame:
    """(lap_id, sample_idx, time_s): a clock for laps without one: distance over speed, no slower than
    1 m/s, added up along the lap."""
    steps = F.transform(
        "distance_m",
        lambda d, i: F.when(i == 0, F.lit(0.0)).otherwise(
            (d - F.get("distance_m", i - 1))
            / F.greatest(F.get("speed_kmh", i - 1) / F.lit(3.6), F.lit(1.0))
        ),
    )
    so_far = Window.partitionBy("lap_id").orderBy("sample_idx")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laps.select("lap_id", F.posexplode(steps).alias("sample_idx", "_step")).select(
        "lap_id",
        (F.col("sample_idx") + 1).alias("sample_idx"),
        F.sum("_step").over(so_far).alias("time_s"),
    )


def with_accelerations(laps: DataFrame) -> DataFrame:
    return (
        laps.withColumn("smooth_kmh", lowpass("speed_kmh", "time_s"))
        .withColumn("accel_ms2", longitudinal_accel("speed_kmh", "time_s"))
        .withColumn("lateral_ms2", lateral_accel("x", "y", "time_s"))
    )


def deployment_samples(points: DataFrame) -> DataFrame:
    """Full throttle, off the brake, nearly straight, and physically plausible."""
    return points.where(
        (F.col("throttle") >= FULL_THROTTLE)
        & ~F.col("brake")
        & (F.abs("lateral_ms2") < MAX_LATERAL_MS2)
        & (F.abs("accel_ms2") <= MAX_LONGITUDINAL_MS2)
    )


def accel_samples(laps: DataFrame, per_driver: int = 5) -> DataFrame:
    """Speed and acceleration at full throttle on each driver's best race laps, one row per sample."""
    race = laps.where(
        (F.col("session_type") == "R")
        & F.col("is_representative")
        & F.col("constructor").isNotNull()
    )
    picked = with_accelerations(fastest_laps_per_driver(race, per_driver, "lap_id"))
    long = samples(picked, LAP, "speed_kmh", "accel_ms2", "lateral_ms2", "throttle", "brake")
    return deployment_samples(long).select(*LAP, "sample_idx", "speed_kmh", "accel_ms2")


def flat_out() -> Column:
    return (F.col("throttle") >= FULL_THROTTLE) & ~F.col("brake")


def straight_samples(points: DataFrame, keys: list[str]) -> DataFrame:
    """Flat-out samples numbered by straight (`island`), with whether braking follows them."""
    lap = Window.partitionBy(*keys).orderBy("sample_idx")
    marked = points.withColumn("_wot", flat_out())
    turned = F.col("_wot") != F.coalesce(F.lag("_wot").over(lap), ~F.col("_wot"))
    return (
        marked.withColumn("island", F.sum(turned.cast("int")).over(lap))
        .withColumn("_next_brake", F.lead("brake").over(lap))
        .where(F.col("_wot"))
        .drop("_wot")
    )


def wot_straights(points: DataFrame, keys: list[str]) -> DataFrame:
    """Flat-out runs that are long or fast enough to be straights."""
    return (
        straight_samples(points, keys)
        .groupBy(*keys, "island")
        .agg(
            F.min("distance_m").alias("start_m"),
            F.max("distance_m").alias("end_m"),
            F.max("speed_kmh").alias("top_kmh"),
            F.count("*").alias("n_samples"),
            F.max_by("_next_brake", "sample_idx").alias("_next_brake"),
        )
        .where(
            (F.col("end_m") - F.col("start_m") >= MIN_STRAIGHT_M)
            | (F.col("top_kmh") >= MIN_STRAIGHT_TOP_KMH)
        )
        .withColumn(
            "end_reason", F.when(F.coalesce("_next_brake", F.lit(False)), "brake").otherwise("lift")
        )
        .drop("_next_brake")
    )


def clip_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of clip samples shorter than the minimum go back to deploy. Adds `run` and `kept`."""
    order = Window.partitionBy(*keys).orderBy("sample_idx")
    clip = F.col("state") != "deploy"
    turned = F.coalesce(clip != (F.lag("state").over(order) != "deploy"), F.lit(True))
    run = Window.partitionBy(*keys, "run")
    return (
        states.withColumn("run", F.sum(turned.cast("int")).over(order))
        .withColumn("_n", F.count("*").over(run))
        .withColumn(
            "kept",
            F.when(clip & (F.col("_n") < MIN_CLIP_SAMPLES), "deploy").otherwise(F.col("state")),
        )
        .drop("_n")
    )


def with_clip_steps(states: DataFrame, keys: list[str]) -> DataFrame:
    """Metres from each sample to the next one of the same run, counted for the left sample."""
    run = Window.partitionBy(*keys, "run").orderBy("sample_idx")
    step = F.coalesce(F.lead("distance_m").over(run) - F.col("distance_m"), F.lit(0.0))
    return (
        states.withColumn("_depletion", F.when(F.col("kept") == "depletion", step).otherwise(0.0))
        .withColumn("_superclip", F.when(F.col("kept") == "superclip", step).otherwise(0.0))
    )


CLIP_METRES = {"_depletion": "depletion_m", "_superclip": "superclip_m"}


def clip_totals() -> list[Column]:
    return [F.sum(step).alias(name) for step, name in CLIP_METRES.items()]


def clip_type() -> Column:
    depletion, superclip = F.col("depletion_m") > 0, F.col("superclip_m") > 0
    return (
        F.when(depletion & superclip, "mixed")
        .when(depletion, "depletion")
        .when(superclip, "superclip")
        .otherwise("")
    )


def clip_lengths(states: DataFrame, keys: list[str]) -> DataFrame:
    return (
        with_clip_steps(states, keys)
        .groupBy(*keys)
        .agg(*clip_totals())
        .withColumn("clip_m", F.col("depletion_m") + F.col("superclip_m"))
        .withColumn("clip_type", clip_type())
    )


def residual_state(value: Column, by_fit: Column) -> Column:
    fitted = (
        F.when(value > DEPLETION_MS2, "deploy")
        .when(value > SUPERCLIP_RESIDUAL_MS2, "depletion")
        .otherwise("superclip")
    )
    gated = (
        F.when(value >= DEPLETION_MS2, "deploy")
        .when(value >= SUPERCLIP_GATE_MS2, "depletion")
        .otherwise("superclip")
    )
    return F.when(by_fit, fitted).otherwise(gated)


def detect_clipping(laps: DataFrame) -> DataFrame:
    """Straights of each lap with the metres on which the car stops accelerating at full throttle.

    Expected acceleration comes from the straight's own rising part where it has enough of it, else
    fixed gates apply. Every window is over one lap's samples."""
    keys = LAP
    sensed = laps.withColumn("smooth_kmh", lowpass("speed_kmh", "time_s")).withColumn(
        "accel_ms2", longitudinal_accel("speed_kmh", "time_s")
    )
    long = samples(
        sensed.where(F.size("distance_m") >= 3),
        keys,
        *["distance_m", "speed_kmh", "throttle", "brake", "smooth_kmh", "accel_ms2"],
    )
    straight = [*keys, "island"]
    whole = Window.partitionBy(*straight)
    order = whole.orderBy("sample_idx")
    lap = Window.partitionBy(*keys)
    v2 = F.pow(F.col("smooth_kmh") / 3.6, 2)
    run = (
        straight_samples(long, keys)
        .withColumn("start_m", F.min("distance_m").over(whole))
        .withColumn("end_m", F.max("distance_m").over(whole))
        .withColumn("_top", F.max("speed_kmh").over(whole))
        .where(
            (F.col("end_m") - F.col("start_m") >= MIN_STRAIGHT_M)
            | (F.col("_top") >= MIN_STRAIGHT_TOP_KMH)
        )
        .withColumn("_lap_top", F.max("_top").over(lap))
        .withColumn("peak_kmh", F.max("smooth_kmh").over(whole))
        .withColumn(
            "_peak_idx",
            F.min(F.when(F.col("smooth_kmh") == F.col("peak_kmh"), F.col("sample_idx"))).over(
                whole
            ),
        )
        .withColumn(
            "_rising",
            (F.col("smooth_kmh") > F.lag("smooth_kmh").over(order))
            & (F.col("smooth_kmh") >= RISING_SPEED_KMH),
        )
        .withColumn("_x", F.when(F.col("_rising"), v2))
        .withColumn("_y", F.when(F.col("_rising"), F.col("accel_ms2")))
        .withColumn("_n_rising", F.count("_x").over(whole))
        .withColumn("_slope", F.regr_slope("_y", "_x").over(whole))
        .withColumn("_intercept", F.regr_intercept("_y", "_x").over(whole))
        .withColumn(
            "_by_fit",
            F.coalesce(
                (F.col("_n_rising") >= MIN_RISING_SAMPLES) & (F.col("_slope") < 0), F.lit(False)
            ),
        )
    )
    residual = F.col("accel_ms2") - (F.col("_intercept") + F.col("_slope") * v2)
    clamped = F.greatest(F.lit(-MAX_RESIDUAL_MS2), F.least(F.lit(MAX_RESIDUAL_MS2), residual))
    measured = F.when(F.col("_by_fit"), clamped).otherwise(F.col("accel_ms2"))
    live = (
        (F.col("smooth_kmh") >= CLIP_SPEED_KMH)
        & (F.col("sample_idx") > F.col("_peak_idx"))
        & (F.col("smooth_kmh") <= F.col("peak_kmh") - CLIP_DROP_KMH)
    )
    judged = run.withColumn("_residual", F.when(live, measured).otherwise(0.0)).withColumn(
        "state",
        F.when(live, residual_state(F.col("_residual"), F.col("_by_fit"))).otherwise("deploy"),
    )
    settled = clip_states(judged, straight)
    clipped = F.col("kept") != "deploy"
    rows = (
        with_clip_steps(settled, straight)
        .groupBy(*straight)
        .agg(
            F.max("start_m").alias("start_m"),
            F.max("end_m").alias("end_m"),
            F.max("peak_kmh").alias("peak_kmh"),
            F.max(F.when(F.col("sample_idx") == F.col("_peak_idx"), F.col("distance_m"))).alias(
                "peak_at_m"
            ),
            *clip_totals(),
            F.max_by("smooth_kmh", "sample_idx").alias("_end_kmh"),
            F.max_by("_next_brake", "sample_idx").alias("_next_brake"),
            F.max("_lap_top").alias("_lap_top"),
            F.min(F.when(clipped, F.col("_residual"))).alias("_worst"),
            F.bool_or("_by_fit").alias("_by_fit"),
        )
        .withColumn("clip_m", F.col("depletion_m") + F.col("superclip_m"))
    )
    is_clip = (F.col("peak_kmh") >= F.lit(CLIP_TOP_SHARE) * F.col("_lap_top")) & (
        F.col("clip_m") >= MIN_CLIP_M
    )
    return rows.select(
        *straight,
        "start_m",
        "end_m",
        "peak_kmh",
        "peak_at_m",
        "clip_m",
        "depletion_m",
        "superclip_m",
        (F.col("peak_kmh") - F.col("_end_kmh")).alias("drop_kmh"),
        F.when(F.coalesce("_next_brake", F.lit(False)), "brake").otherwise("lift").alias(
            "end_reason"
        ),
        is_clip.alias("is_clip"),
        clip_type().alias("clip_type"),
        F.when(is_clip, F.coalesce("_worst", F.lit(0.0))).otherwise(0.0).alias("clip_severity_ms2"),
        F.when(F.col("_by_fit"), "ddr").otherwise("ssdg").alias("method"),
    )


def clip_summary(straights: DataFrame, keys: list[str] = LAP) -> DataFrame:
    """Totals over the clipped straights of each lap; the worst severity is the most negative."""
    clip = F.col("is_clip")

    def total(name: str) -> Column:
        return F.bround(F.sum(F.when(clip, F.col(name)).otherwise(0.0)), 1).alias(f"total_{name}")

    return straights.groupBy(*keys).agg(
        F.count("*").alias("n_straights"),
        F.count_if(clip).alias("n_clips"),
        total("clip_m"),
        total("depletion_m"),
        total("superclip_m"),
        F.bround(F.max(F.when(clip, F.col("clip_m")).otherwise(0.0)), 1).alias("max_clip_m"),
        F.bround(F.coalesce(F.min(F.when(clip, F.col("clip_severity_ms2"))), F.lit(0.0)), 2).alias(
            "max_clip_severity_ms2"
        ),
        F.bround(F.max("peak_kmh"), 1).alias("top_speed_kmh"),
    )


def straight_rows(straights: DataFrame, keys: list[str] = LAP) -> DataFrame:
    """The straights of each lap as one array of rounded records; a lap has a few dozen at most."""
    whole = ["start_m", "end_m", "peak_kmh", "peak_at_m", "clip_m", "depletion_m", "superclip_m"]
    record = F.struct(
        *[F.bround(c).cast("int").alias(c) for c in whole],
        F.bround("drop_kmh").cast("int").alias("drop_kmh"),
        "end_reason",
        "is_clip",
        "clip_type",
        F.bround("clip_severity_ms2", 2).alias("clip_severity_ms2"),
        "method",
    )
    return straights.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("straights"))


def plausible_laps(laps: DataFrame) -> DataFrame:
    """Laps whose recorded length is near the session's median length."""
    measured = laps.withColumn("length_m", F.array_max("distance_m"))
    typical = exact_quantiles(measured, SESSION_KEYS, "length_m", {"typical_m": 0.5})
    return measured.join(typical, SESSION_KEYS).where(
        F.abs(F.col("length_m") - F.col("typical_m")) <= MAX_LENGTH_DEVIATION_M
    )


def distance_grid(length: Column, step: float = GRID_STEP_M) -> Column:
    """0, step, 2*step, ... below the length, then the length itself."""
    steps = F.ceil(length / step).cast("int")
    inner = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: i * F.lit(step))
    return F.when(length <= 0, F.array(F.lit(0.0))).otherwise(
        F.concat(inner, F.array(F.round(length, 1)))
    )


def resampled(laps: DataFrame, at: Column, *channels: str) -> DataFrame:
    """Channels interpolated at the distances `at`, in place of the raw ones."""
    out = laps.withColumn("_at", at)
    for c in channels:
        out = out.withColumn(c, interpolate("_at", "distance_m", F.col(c).cast("array<double>")))
    return out.withColumn("distance_m", F.col("_at")).drop("_at")


def aligned_traces(laps: DataFrame) -> DataFrame:
    """Each driver's fastest lap on the session's common grid, matched by lap fraction, with the time
    lost to the pole lap at every grid point. One row per driver, arrays per grid point."""
    # One lap per driver is left here; it is read several times from now on, so it is stored.
    fastest = work_table(
        first_by(
            laps.where(F.col("is_representative")),
            [*SESSION_KEYS, "driver"],
            "lap_time_s",
            "lap_id",
        ),
        "fastest",
    )
    kept = plausible_laps(fastest)
    nominal = exact_quantiles(kept, SESSION_KEYS, "length_m", {"nominal_m": 0.5})
    own = F.element_at("distance_m", -1)
    on_grid = (
        kept.join(nominal, SESSION_KEYS)
        .withColumn("grid_m", distance_grid(F.col("nominal_m")))
        .withColumn("time_s", lap_relative_time(F.col("time_s")))
    )
    query = F.transform("grid_m", lambda g: g * own / F.col("nominal_m"))
    traced = work_table(
        resampled(on_grid, query, "speed_kmh", "throttle", "time_s").drop("distance_m"), "traced"
    )
    pole = traced.groupBy(*SESSION_KEYS).agg(
        F.min_by(F.struct("lap_id", "time_s"), F.struct("lap_time_s", "lap_id")).alias("_pole")
    )
    return (
        traced.join(pole, SESSION_KEYS)
        .withColumn("is_pole", F.col("lap_id") == F.col("_pole.lap_id"))
        .withColumn("delta_s", F.zip_with("time_s", "_pole.time_s", lambda a, b: a - b))
        .select(
            *LAP, "lap_time_s", "is_pole", "grid_m", "speed_kmh", "throttle", "time_s", "delta_s"
        )
    )


def trace_page(traces: DataFrame) -> DataFrame:
    """Drivers of a session in the order of their lap times, with their place, the length of the common
    grid and what they lost on the pole lap at its end. A session has a grid's worth of rows."""
    order = Window.partitionBy(*SESSION_KEYS).orderBy("lap_time_s", "lap_id")
    return traces.select(
        *LAP,
        "is_pole",
        "lap_time_s",
        F.size("grid_m").cast("bigint").alias("n_points"),
        F.element_at("grid_m", -1).alias("grid_end_m"),
        F.element_at("delta_s", -1).alias("lost_s"),
        F.row_number().over(order).cast("bigint").alias("place"),
    )
