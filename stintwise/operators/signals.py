"""Signal miners, scoring, fusing and ranking. Every miner returns the same columns."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import (
    CLEAN_AIR_RANK_DELTA,
    EXPECTATION_FLOOR,
    MAX_CORNER_DELTA,
    MAX_STRAIGHT_DEFICIT,
    MIN_CLEAN_AIR_LAPS,
    MIN_CLIP_DEFICIT_M,
    MIN_SLOPE_DEVIATION,
    OBVIOUS_DISCOUNT,
    PRACTICE,
    PROGRESSION_MIN_S,
    QUALI_LIKE,
    REAL_STRAIGHT_KMH,
    RESIDUAL_MIN_S,
    SESSION_KEYS,
    WEEKEND_KEYS,
)
from stintwise.functions.skew import attach, first_by, row_numbers, work_table
from stintwise.operators.quali import best_across_sessions, fastest_per_constructor, rank_asc
from stintwise.operators.reads import grid_vs_finish, sprint_vs_race
from stintwise.operators.season import band_fit

COLUMNS = [
    "signal_type",
    "category",
    "magnitude",
    "confidence",
    "subject",
    "locus",
    "session_type",
    "tie",
    "refs",
]
RACE_TYPES = {"R": "", "SPRINT": "sprint_"}


def signals(
    df: DataFrame,
    signal_type: Column | str,
    category: str,
    magnitude: Column,
    subject: str = "constructor",
    confidence: Column | float = 1.0,
    locus: Column | None = None,
    session_type: Column | None = None,
    tie: Column | None = None,
    facts: list[str] | None = None,
) -> DataFrame:
    """Shape mined rows: `facts` become the JSON evidence of the one reference."""
    kind = F.lit(signal_type) if isinstance(signal_type, str) else signal_type
    trust = confidence if isinstance(confidence, Column) else F.lit(confidence)
    nothing = F.lit(None).cast("string")
    fact = F.to_json(F.struct(kind.alias("type"), *(facts or [subject])))
    return df.select(
        *WEEKEND_KEYS,
        kind.alias("signal_type"),
        F.lit(category).alias("category"),
        magnitude.cast("double").alias("magnitude"),
        trust.cast("double").alias("confidence"),
        F.col(subject).alias("subject"),
        (nothing if locus is None else locus).alias("locus"),
        (nothing if session_type is None else session_type).alias("session_type"),
        (F.lit("") if tie is None else tie.cast("string")).alias("tie"),
        F.array(fact).alias("refs"),
    )


def race_kind(race_name: str, sprint_name: str) -> Column:
    return F.when(F.col("session_type") == "R", race_name).otherwise(sprint_name)


def corner_delta(pairs: DataFrame) -> DataFrame:
    slower = F.when(F.col("delta_kmh") > 0, F.col("constructor_b")).otherwise(
        F.col("constructor_a")
    )
    rows = pairs.where(
        F.col("delta_kmh").isNotNull()
        & F.col("confidence").isNotNull()
        & (F.abs("delta_kmh") <= MAX_CORNER_DELTA)
    ).withColumn("slower", slower)
    return signals(
        rows,
        "corner_delta",
        "corner",
        F.abs("delta_kmh"),
        "slower",
        F.col("confidence"),
        F.format_string("corner:%d", "corner_number"),
        F.col("session_type"),
        F.concat_ws("|", "constructor_a", "constructor_b"),
        [*SESSION_KEYS, "corner_number", "speed_class", "constructor_a", "constructor_b",
         "delta_kmh", "car_pct", "driver_pct"],
    )


def straight_delta(zones: DataFrame) -> DataFrame:
    teams = (
        zones.where(F.col("constructor").isNotNull() & F.col("max_speed_kmh").isNotNull())
        .groupBy(*SESSION_KEYS, "zone", "constructor")
        .agg(F.avg("max_speed_kmh").alias("kmh"))
    )
    field = Window.partitionBy(*SESSION_KEYS, "zone")
    rows = (
        teams.withColumn("fastest_kmh", F.max("kmh").over(field))
        .withColumn("_teams", F.count("*").over(field))
        .withColumn(
            "fastest_constructor",
            F.max_by("constructor", "kmh").over(field),
        )
        .withColumn("deficit_kmh", F.col("fastest_kmh") - F.col("kmh"))
        .where(
            (F.col("_teams") >= 2)
            & (F.col("fastest_kmh") >= REAL_STRAIGHT_KMH)
            & (F.col("deficit_kmh") > 0)
            & (F.col("deficit_kmh") <= MAX_STRAIGHT_DEFICIT)
        )
    )
    return signals(
        rows,
        "straight_delta",
        "straight",
        F.col("deficit_kmh"),
        locus=F.format_string("straight:%d", "zone"),
        session_type=F.col("session_type"),
        facts=[*SESSION_KEYS, "zone", "constructor", "deficit_kmh", "fastest_constructor",
               "fastest_kmh"],
    )


def pace_deficit(team_pace: DataFrame) -> DataFrame:
    rows = team_pace.where(F.col("session_type").isin("R", "SPRINT") & (F.col("gap_s") > 0))
    return signals(
        rows,
        race_kind("race_pace", "sprint_pace"),
        "pace",
        F.col("gap_s"),
        session_type=F.col("session_type"),
        facts=["constructor", "gap_s", "session_type"],
    )


def clean_air_shift(clean: DataFrame) -> DataFrame:
    """Teams whose clean-air place differs from their plain place, both within the same subset."""
    field = Window.partitionBy(*SESSION_KEYS)
    rows = (
        clean.where(
            F.col("session_type").isin("R", "SPRINT")
            & (F.col("clean_laps") >= MIN_CLEAN_AIR_LAPS)
        )
        .withColumn("median_rank", rank_asc("gap_s", SESSION_KEYS))
        .withColumn("clean_air_rank", rank_asc("clean_gap_s", SESSION_KEYS))
        .withColumn("_teams", F.count("*").over(field))
        .where(
            (F.col("_teams") >= 2)
            & (F.abs(F.col("median_rank") - F.col("clean_air_rank")) >= CLEAN_AIR_RANK_DELTA)
        )
    )
    return signals(
        rows,
        race_kind("race_clean_air_pace", "sprint_clean_air_pace"),
        "clean_air_pace",
        F.abs(F.col("gap_s") - F.col("clean_gap_s")),
        session_type=F.col("session_type"),
        facts=["constructor", "median_rank", "clean_air_rank", "gap_s", "clean_gap_s",
               "clean_median_s", "clean_laps", "session_type"],
    )


def position_swing(results: DataFrame, quali: str, race: str, name: str) -> DataFrame:
    rows = grid_vs_finish(results, quali, race).where(F.col("constructor").isNotNull())
    return signals(
        rows,
        name,
        "result",
        F.abs("swing"),
        session_type=F.lit(race),
        tie=F.col("driver"),
        facts=["driver", "constructor", "grid", "finish", "swing"],
    )


def sector_delta(sector_bests: DataFrame) -> DataFrame:
    practice = sector_bests.where(F.col("session_type").isin(PRACTICE))
    teams = (
        best_across_sessions(practice)
        .where(F.col("constructor").isNotNull())
        .groupBy(*WEEKEND_KEYS, "sector", "constructor")
        .agg(F.min("best_time_s").alias("best_time_s"))
    )
    field = Window.partitionBy(*WEEKEND_KEYS, "sector")
    rows = (
        teams.withColumn("fastest_s", F.min("best_time_s").over(field))
        .withColumn("_teams", F.count("*").over(field))
        .withColumn("deficit_s", F.col("best_time_s") - F.col("fastest_s"))
        .where((F.col("_teams") >= 2) & (F.col("deficit_s") > 0))
    )
    return signals(
        rows,
        "sector_delta",
        "sector",
        F.col("deficit_s"),
        locus=F.format_string("sector:%d", "sector"),
        session_type=F.lit("practice"),
        facts=["sector", "constructor", "best_time_s", "deficit_s", "fastest_s"],
    )


def quali_reps(quali_rows: DataFrame) -> DataFrame:
    return fastest_per_constructor(
        quali_rows.where(
            F.col("session_type").isin(QUALI_LIKE) & F.col("top_speed_kmh").isNotNull()
        )
    )


def quali_deficit(reps: DataFrame, value: str, name: str) -> DataFrame:
    """Shortfall of each team's fastest lap against the field's best of `value`."""
    field = Window.partitionBy(*SESSION_KEYS)
    rows = (
        reps.where(F.col(value).isNotNull())
        .withColumn("best_kmh", F.max(value).over(field))
        .withColumn("_teams", F.count("*").over(field))
        .withColumn("deficit_kmh", F.col("best_kmh") - F.col(value))
        .where((F.col("_teams") >= 2) & (F.col("deficit_kmh") > 0))
    )
    return signals(
        rows,
        name,
        "quali_character",
        F.col("deficit_kmh"),
        session_type=F.col("session_type"),
        facts=["constructor", "driver", value, "deficit_kmh", "best_kmh", "session_type"],
    )


def quali_progression(results: DataFrame) -> DataFrame:
    """Improvement over qualifying of each team's best car against the field's."""
    final = F.coalesce("q3_time_s", "q2_time_s")
    cars = (
        results.where(
            F.col("session_type").isin(QUALI_LIKE)
            & F.col("constructor").isNotNull()
            & F.col("q1_time_s").isNotNull()
        )
        .withColumn("final_s", final)
        .where(F.col("final_s").isNotNull())
        .withColumn("improvement_s", F.col("q1_time_s") - F.col("final_s"))
    )
    # A field of three teams implies three cars, the other condition of the rule.
    reps = first_by(
        cars.select(*SESSION_KEYS, "constructor", "driver", "final_s", "improvement_s"),
        [*SESSION_KEYS, "constructor"],
        "final_s",
        "driver",
    )
    field = Window.partitionBy(*SESSION_KEYS)
    rows = (
        reps.withColumn("field_s", F.avg("improvement_s").over(field))
        .withColumn("_teams", F.count("*").over(field))
        .withColumn("deviation_s", F.col("improvement_s") - F.col("field_s"))
        .where((F.col("_teams") >= 3) & (F.abs("deviation_s") >= PROGRESSION_MIN_S))
    )
    return signals(
        rows,
        "quali_progression",
        "quali_character",
        F.abs("deviation_s"),
        confidence=0.8,
        session_type=F.col("session_type"),
        facts=["constructor", "driver", "improvement_s", "field_s", "session_type"],
    )


def pace_speed_residual(reps: DataFrame) -> DataFrame:
    """Lap time against what the team's top speed predicts."""
    field = Window.partitionBy(*SESSION_KEYS)
    predicted = F.col("_slope") * F.col("top_speed_kmh") + F.col("_intercept")
    rows = (
        reps.withColumn("_teams", F.count("*").over(field))
        .withColumn("_slope", F.regr_slope("lap_time_s", "top_speed_kmh").over(field))
        .withColumn("_intercept", F.regr_intercept("lap_time_s", "top_speed_kmh").over(field))
        .withColumn("residual_s", F.col("lap_time_s") - predicted)
        .where((F.col("_teams") >= 4) & (F.abs("residual_s") >= RESIDUAL_MIN_S))
    )
    return signals(
        rows,
        "quali_pace_speed_residual",
        "quali_character",
        F.abs("residual_s"),
        confidence=0.75,
        session_type=F.col("session_type"),
        facts=["constructor", "driver", "lap_time_s", "top_speed_kmh", "residual_s"],
    )


def deployment_clip(clips: DataFrame, straights: DataFrame | None = None) -> DataFrame:
    """Teams whose cars both clip, by how much more than the best such team."""
    clipping = F.col("max_clip_m") > 0
    teams = (
        clips.where(F.col("session_type").isin(QUALI_LIKE) & F.col("constructor").isNotNull())
        .groupBy(*SESSION_KEYS, "constructor")
        .agg(
            F.count_if(clipping).alias("_cars"),
            F.min(F.when(clipping, F.col("total_clip_m"))).alias("clip_m"),
        )
    )
    field = Window.partitionBy(*SESSION_KEYS)
    rows = (
        teams.withColumn("_teams", F.count("*").over(field))
        .where((F.col("_teams") >= 2) & (F.col("_cars") >= 2))
        .withColumn("best_m", F.min("clip_m").over(field))
        .withColumn("_kept", F.count("*").over(field))
        .withColumn("excess_m", F.col("clip_m") - F.col("best_m"))
        .where((F.col("_kept") >= 2) & (F.col("excess_m") > MIN_CLIP_DEFICIT_M))
    )
    facts = ["constructor", "clip_m", "excess_m", "best_m", "session_type"]
    if straights is not None:
        worst = (
            straights.where(F.col("is_clip"))
            .groupBy(*SESSION_KEYS, "constructor")
            .agg(
                F.max_by(
                    F.struct("driver", "start_m", "end_m", "peak_kmh", "clip_m", "clip_type"),
                    F.struct("clip_m", "lap_id", "island"),
                ).alias("worst_straight")
            )
        )
        rows = rows.join(worst, [*SESSION_KEYS, "constructor"], "left")
        facts.append("worst_straight")
    return signals(
        rows,
        "deployment_clip",
        "deployment",
        F.col("excess_m"),
        session_type=F.col("session_type"),
        facts=facts,
    )


def ers_character(points: DataFrame) -> DataFrame:
    """How acceleration changes with speed in the harvesting band, against the field."""
    fits = band_fit(points.where(F.col("session_type") == "R"), [*WEEKEND_KEYS, "constructor"])
    field = Window.partitionBy(*WEEKEND_KEYS)
    rows = (
        fits.withColumn("field_slope", F.avg("slope").over(field))
        .withColumn("_teams", F.count("*").over(field))
        .withColumn("deviation", F.col("slope") - F.col("field_slope"))
        .where((F.col("_teams") >= 3) & (F.abs("deviation") >= MIN_SLOPE_DEVIATION))
    )
    return signals(
        rows,
        "ers_deployment_character",
        "deployment",
        F.abs("deviation"),
        confidence=0.7,
        session_type=F.lit("R"),
        facts=["constructor", "slope", "field_slope", "n_points"],
    )


def degradation(wear: DataFrame) -> DataFrame:
    rows = wear.where(
        F.col("session_type").isin("R", "SPRINT") & (F.col("slope_s_per_lap") > 0)
    )
    return signals(
        rows,
        race_kind("tyre_degradation", "sprint_degradation"),
        "degradation",
        F.col("cost_s"),
        locus=F.concat(F.lit("compound:"), "compound"),
        session_type=F.col("session_type"),
        facts=["constructor", "compound", "slope_s_per_lap", "cost_s", "n_laps", "flagged",
               "session_type"],
    )


def sprint_race_delta(team_pace: DataFrame) -> DataFrame:
    return signals(
        sprint_vs_race(team_pace),
        "sprint_race_pace_delta",
        "cross_event",
        F.abs("delta_s"),
        facts=["constructor", "sprint_gap_s", "race_gap_s", "delta_s"],
    )


# Adding a miner means adding an entry here.
MINERS: dict[str, Callable] = {
    "corner_delta": lambda m: corner_delta(m.pairs),
    "straight_delta": lambda m: straight_delta(m.zones),
    "pace": lambda m: pace_deficit(m.team_pace),
    "clean_air": lambda m: clean_air_shift(m.clean_air),
    "position_swing": lambda m: position_swing(m.results, "Q", "R", "position_swing"),
    "sprint_position_swing": lambda m: position_swing(
        m.results, "SQ", "SPRINT", "sprint_position_swing"
    ),
    "sector_delta": lambda m: sector_delta(m.sector_bests),
    "quali_top_speed": lambda m: quali_deficit(
        quali_reps(m.quali_rows), "top_speed_kmh", "quali_top_speed_delta"
    ),
    "quali_grip": lambda m: quali_deficit(
        quali_reps(m.quali_rows), "min_speed_kmh", "quali_grip_delta"
    ),
    "quali_progression": lambda m: quali_progression(m.results),
    "pace_speed_residual": lambda m: pace_speed_residual(quali_reps(m.quali_rows)),
    "deployment_clip": lambda m: deployment_clip(m.clips, m.clip_straights),
    "ers_character": lambda m: ers_character(m.accel),
    "degradation": lambda m: degradation(m.wear),
    "sprint_race_delta": lambda m: sprint_race_delta(m.team_pace),
}


def all_signals(inputs, miners: dict[str, Callable] | None = None) -> DataFrame:
    parts = [mine(inputs) for mine in (miners or MINERS).values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- scoring ----------------------------------------------------------------


def actual_ranks(results: DataFrame) -> DataFrame:
    """Constructors by best race finish."""
    best = (
        results.where(
            (F.col("session_type") == "R")
            & F.col("position").isNotNull()
            & F.col("constructor").isNotNull()
        )
        .groupBy(*WEEKEND_KEYS, "constructor")
        .agg(F.min("position").alias("best_position"))
    )
    return best.withColumn("actual_rank", rank_asc("best_position", WEEKEND_KEYS))


def expectation_factors(snapshot: DataFrame, actual: DataFrame) -> DataFrame:
    """Damping of teams that finished where the season says they should; 1.0 for surprises."""
    expected = snapshot.where(F.col("overall_rank").isNotNull()).select(
        "year", "constructor", F.col("overall_rank").alias("expected_rank")
    )
    field = Window.partitionBy(*WEEKEND_KEYS)
    span = F.greatest(F.col("_teams") - 1, F.lit(1))
    share = F.abs(F.col("expected_rank") - F.col("actual_rank")) / span
    return (
        actual.withColumn("_teams", F.count("*").over(field))
        .join(expected, ["year", "constructor"])
        .withColumn(
            "factor",
            F.lit(EXPECTATION_FLOOR)
            + F.lit(1 - EXPECTATION_FLOOR) * F.least(F.lit(1.0), share),
        )
        .select(*WEEKEND_KEYS, "constructor", "expected_rank", "actual_rank", "factor")
    )


def score_signals(mined: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Robustness: size within its type, times confidence, discounted when obvious and damped by
    expectation. `mined` is read twice, so hand in a stored table."""
    peak = F.max(F.abs("magnitude")).alias("_peak")
    size = F.when(F.col("_peak") > 0, F.abs("magnitude") / F.col("_peak")).otherwise(0.0)
    plain = size * F.col("confidence") * F.when(
        F.col("category") == "result", F.lit(OBVIOUS_DISCOUNT)
    ).otherwise(1.0)
    rows = attach(mined, [*WEEKEND_KEYS, "signal_type"], peak).withColumn("robustness", plain)
    if factors is not None:
        damp = factors.select(*WEEKEND_KEYS, F.col("constructor").alias("subject"), "factor")
        rows = (
            rows.join(damp, [*WEEKEND_KEYS, "subject"], "left")
            .withColumn("robustness", F.col("robustness") * F.coalesce("factor", F.lit(1.0)))
            .drop("factor")
        )
    return rows.drop("_peak")


SUBJECT = [*WEEKEND_KEYS, "subject"]


def strength() -> list[Column]:
    return [
        -F.round("robustness", 9),
        F.col("category"),
        F.col("signal_type"),
        F.coalesce("locus", F.lit("")),
        F.coalesce("session_type", F.lit("")),
        F.col("tie"),
    ]


def fuse_channels(scored: DataFrame) -> DataFrame:
    """Subjects seen in two or more categories become one cross-session finding; all rows of the
    other subjects stay. A subject has one strongest row per category, so a handful."""
    best = first_by(scored, [*SUBJECT, "category"], *[s for s in strength()])
    merged = (
        best.groupBy(*SUBJECT)
        .agg(
            F.count("*").alias("_channels"),
            F.min_by(F.struct("magnitude", "locus"), F.struct(*strength())).alias("_main"),
            F.avg("confidence").alias("confidence"),
            F.sum("robustness").alias("robustness"),
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("category", "refs"))),
                    lambda p: p["refs"],
                )
            ).alias("refs"),
        )
        .where(F.col("_channels") >= 2)
        .select(
            *SUBJECT,
            F.lit("cross_session").alias("signal_type"),
            F.lit("cross_session").alias("category"),
            "_main.magnitude",
            "confidence",
            "_main.locus",
            F.lit(None).cast("string").alias("session_type"),
            F.lit("").alias("tie"),
            "refs",
            "robustness",
        )
    )
    alone = scored.join(merged.select(*SUBJECT), SUBJECT, "left_anti")
    return alone.unionByName(merged)


def rank_signals(fused: DataFrame) -> DataFrame:
    order = [
        -F.round("robustness", 9),
        F.col("subject"),
        F.col("category"),
        F.col("signal_type"),
        F.coalesce("locus", F.lit("")),
        F.coalesce("session_type", F.lit("")),
        F.col("tie"),
    ]
    return row_numbers(fused, WEEKEND_KEYS, order, "rank")


def candidates(mined: DataFrame, snapshot: DataFrame, results: DataFrame) -> DataFrame:
    """Score, fuse and rank mined signals of all weekends at once."""
    factors = expectation_factors(snapshot, actual_ranks(results))
    return rank_signals(fuse_channels(work_table(score_signals(mined, factors), "scored")))


def top_candidates(ranked: DataFrame, n: int = 10, category: str = "") -> DataFrame:
    rows = ranked.where(F.col("category") == category) if category else ranked
    order = Window.partitionBy(*WEEKEND_KEYS).orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
