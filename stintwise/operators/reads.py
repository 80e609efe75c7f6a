"""Read shapes: rankings with gaps, stint comparisons, lookups and summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.constants import INDICATIVE, MIN_POSITION_SWING, SESSION_KEYS, WEEKEND_KEYS
from stintwise.functions.expressions import compound_letter, format_gap_label
from stintwise.functions.skew import attach, neighbours
from stintwise.operators.laps import DRIVER_KEYS, STINT_KEYS


def gap_to_team_ahead(index: DataFrame, clean: DataFrame) -> DataFrame:
    """Race pace ranking with the gap to the next team above that has one, and clean-air figures."""
    weekend = Window.partitionBy(*WEEKEND_KEYS).orderBy("overall_rank")
    above = F.last("lap_deficit_s", ignorenulls=True).over(
        weekend.rowsBetween(Window.unboundedPreceding, -1)
    )
    gap = F.when(
        F.col("lap_deficit_s").isNotNull(),
        F.when(above.isNull(), F.lit(0.0)).otherwise(F.bround(F.col("lap_deficit_s") - above, 3)),
    )
    figures = clean.where(F.col("session_type") == "R").select(
        *WEEKEND_KEYS,
        "constructor",
        F.bround("clean_median_s", 3).alias("clean_air_median_s"),
        F.bround("clean_gap_s", 3).alias("clean_air_gap_s"),
        F.col("clean_laps").alias("clean_air_laps"),
    )
    return (
        index.withColumn("gap_to_team_ahead_s", gap)
        .select(*WEEKEND_KEYS, "constructor", "overall_rank", "lap_deficit_s", "gap_to_team_ahead_s")
        .join(figures, [*WEEKEND_KEYS, "constructor"], "left")
    )


def final_stint_delta(stints: DataFrame, drivers: list[int]) -> DataFrame:
    """Average of each asked driver's last stint against the best last stint among them."""
    last = (
        stints.where(F.col("driver").isin(drivers))
        .groupBy(*DRIVER_KEYS)
        .agg(
            F.max("stint_number").alias("stint_number"),
            F.max_by("avg_pace_s", "stint_number").alias("avg_pace_s"),
        )
    )
    best = F.min("avg_pace_s").over(Window.partitionBy(*SESSION_KEYS))
    return last.withColumn("final_delta_s", F.bround(F.col("avg_pace_s") - best, 3))


def stints_of_driver(stints: DataFrame, driver: int, session_type: str = "R") -> DataFrame:
    return stints.where(
        (F.col("driver") == driver) & (F.col("session_type") == session_type)
    ).orderBy(*STINT_KEYS)


def lap_evolution(kept: DataFrame, driver: int, stint: int) -> DataFrame:
    return (
        kept.where((F.col("driver") == driver) & (F.col("stint_number") == stint))
        .select(*STINT_KEYS, "compound", "lap_number", "pace_s")
        .orderBy(*STINT_KEYS, "lap_number")
    )


def gap_to_best(value: str, keys: list[str]) -> Column:
    return F.col(value) - F.min(value).over(Window.partitionBy(*keys))


def bar_fraction(value: str, keys: list[str]) -> Column:
    group = Window.partitionBy(*keys)
    best, worst = F.min(value).over(group), F.max(value).over(group)
    return F.when(F.col(value).isNotNull() & (worst == best), F.lit(0.0)).otherwise(
        (F.col(value) - best) / F.nullif(worst - best, F.lit(0.0))
    )


def heat_intensity(rank: Column, total: Column, top: float = 0.22) -> Column:
    share = F.lit(1.0) - (rank - 1) / F.nullif(total - 1, F.lit(0))
    return F.when(total <= 1, F.lit(0.0)).otherwise(F.pow(share, F.lit(3.0)) * F.lit(top))


def grid_vs_finish(results: DataFrame, quali: str = "Q", race: str = "R") -> DataFrame:
    """Places gained from qualifying to the race, where the swing is notable."""
    placed = results.where(F.col("position").isNotNull())
    grid = placed.where(F.col("session_type") == quali).select(
        *WEEKEND_KEYS, "driver", F.col("position").alias("grid")
    )
    finish = placed.where(F.col("session_type") == race).select(
        *WEEKEND_KEYS, "driver", "constructor", F.col("position").alias("finish")
    )
    return (
        finish.join(grid, [*WEEKEND_KEYS, "driver"])
        .withColumn("swing", F.col("grid") - F.col("finish"))
        .where(F.abs("swing") >= MIN_POSITION_SWING)
    )


def sprint_vs_race(team_pace: DataFrame) -> DataFrame:
    """Pace gap in the sprint minus in the race, for teams in both."""
    def of(session: str, name: str) -> DataFrame:
        return team_pace.where(F.col("session_type") == session).select(
            *WEEKEND_KEYS, "constructor", F.col("gap_s").alias(name)
        )

    return (
        of("SPRINT", "sprint_gap_s")
        .join(of("R", "race_gap_s"), [*WEEKEND_KEYS, "constructor"])
        .withColumn("delta_s", F.col("sprint_gap_s") - F.col("race_gap_s"))
        .where(F.col("delta_s") != 0)
    )


def nearest_value(cited: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """For each cited number, the constructor whose measured gap is closest within its weekend, of two as
    close the first by name. A citation meets two measured gaps, the next below and the next above,
    however many there are. A weekend without measured gaps has no row."""
    named = measured.where(F.col("gap_s").isNotNull()).groupBy(*keys, "gap_s").agg(F.min("constructor").alias("constructor"))
    place = F.struct("constructor", "gap_s")
    met = neighbours(
        cited.withColumn("_place", F.col("cited")), named.withColumn("_place", F.col("gap_s")), keys, "_place", place, "_below", "_above"
    )

    def ranked(side: str) -> Column:
        off = F.abs(F.col(f"{side}.gap_s") - F.col("cited"))
        return F.when(
            F.col(side).isNotNull(),
            F.struct(off.alias("off"), F.col(f"{side}.constructor").alias("constructor"), F.col(f"{side}.gap_s").alias("gap_s")),
        )

    near = F.least(ranked("_below"), ranked("_above"))
    return (
        met.withColumn("_near", near)
        .where(F.col("_near").isNotNull())
        .select(*keys, "cite_id", "cited", "_near.constructor", "_near.gap_s")
    )


def tolerance_match(cited: DataFrame, measured: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Whether a measured value lies within `tol` of each cited number.

    Measured values are reduced to the smallest and largest of each bucket as wide as the tolerance:
    a value in the same bucket always matches, a neighbour bucket matches by its nearer edge. Each
    citation thus meets one row, however many values were measured."""
    def seen_from(offset: int, side: str) -> Column:
        return F.struct(
            (F.col("_b") + offset).alias("_bucket"), F.lit(side).alias("_side"), "_min", "_max"
        )

    sides = F.array(seen_from(0, "in"), seen_from(1, "below"), seen_from(-1, "above"))
    edges = (
        measured.groupBy(*keys, F.floor(F.col("measured") / tol).alias("_b"))
        .agg(F.min("measured").alias("_min"), F.max("measured").alias("_max"))
        .select(*keys, F.inline(sides))
        .groupBy(*keys, "_bucket")
        .agg(
            F.max(F.when(F.col("_side") == "below", F.col("_max"))).alias("_below"),
            F.min(F.when(F.col("_side") == "above", F.col("_min"))).alias("_above"),
            F.max(F.when(F.col("_side") == "in", F.col("_max"))).alias("_in"),
        )
    )
    near = (
        F.col("_in").isNotNull()
        | (F.col("cited") - F.col("_below") <= tol)
        | (F.col("_above") - F.col("cited") <= tol)
    )
    return (
        cited.withColumn("_bucket", F.floor(F.col("cited") / tol))
        .join(edges, [*keys, "_bucket"], "left")
        .withColumn("matched", F.coalesce(near, F.lit(False)))
        .drop("_bucket", "_below", "_above", "_in")
    )


def stint_result_join(results: DataFrame, stints: DataFrame) -> DataFrame:
    """Results with each driver's compound sequence, one letter a stint."""
    sequence = stints.groupBy(*DRIVER_KEYS).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("stint_number", "compound"))),
                lambda s: compound_letter(s["compound"]),
            ),
            "-",
        ).alias("strategy")
    )
    label = format_gap_label(
        F.col("position"),
        F.col("gap_to_leader_s"),
        F.col("laps"),
        F.col("leader_laps"),
        F.col("status"),
    )
    return results.join(sequence, DRIVER_KEYS, "left").select(
        *DRIVER_KEYS, "position", label.alias("gap_label"), "strategy"
    )


def clip_field_minimum(clips: DataFrame) -> DataFrame:
    """Each lap's clip totals with the field's smallest, lowest first."""
    return attach(
        clips,
        SESSION_KEYS,
        F.min("total_clip_m").alias("field_min_total_clip_m"),
        F.min("max_clip_m").alias("field_min_max_clip_m"),
    ).orderBy(*SESSION_KEYS, "total_clip_m")


def session_summary(
    sector_bests: DataFrame, dominance: DataFrame, top_speeds: DataFrame, order: DataFrame
) -> DataFrame:
    """The readings of a session in one long frame: (kind, item, driver, value, text)."""
    def rows(df: DataFrame, kind: str, item: Column, driver: Column, value: Column, text: Column):
        return df.select(
            *SESSION_KEYS,
            F.lit(kind).alias("kind"),
            item.cast("string").alias("item"),
            driver.cast("bigint").alias("driver"),
            value.cast("double").alias("value"),
            text.alias("text"),
        )

    c = F.col
    parts = [
        rows(sector_bests, "sector_best", c("sector"), c("driver"), c("best_time_s"), c("constructor")),
        rows(dominance, "dominance", c("sector"), c("driver"), c("margin_s"), c("constructor")),
        rows(top_speeds, "top_speed", F.lit(""), c("driver"), c("max_speed_kmh"), c("constructor")),
        rows(order, "order", c("position"), c("driver"), c("gap_to_leader_s"), c("gap_label")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("indicative", F.col("session_type").isin(INDICATIVE))


def digest_summary(
    weekends: DataFrame,
    race_results: DataFrame,
    race_pace: DataFrame,
    practice_dominance: DataFrame,
    practice_zones: DataFrame,
) -> DataFrame:
    """One row per weekend: winner, fastest team and the next three gaps, practice sector holders and
    practice top speed."""
    winner = race_results.where(F.col("position") == 1).select(
        *WEEKEND_KEYS, F.col("driver").alias("winner"), F.col("constructor").alias("winner_team")
    )
    order = Window.partitionBy(*WEEKEND_KEYS).orderBy("gap_s", "constructor")
    placed = race_pace.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 4)
    text = F.format_string("%s +%.3fs", "constructor", F.col("gap_s") + F.lit(1e-9))
    after = F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", text.alias("_t")))))
    pace = (
        placed.groupBy(*WEEKEND_KEYS)
        .agg(
            F.max(F.when(F.col("_n") == 1, F.col("constructor"))).alias("fastest_team"),
            F.array_join(F.transform(after, lambda s: s["_t"]), "; ").alias("next_gaps"),
            F.count("*").alias("_teams"),
        )
        .where(F.col("_teams") >= 2)
        .drop("_teams")
    )
    holder = F.format_string("S%d %s %d", "sector", "constructor", "driver")
    sectors = practice_dominance.groupBy(*WEEKEND_KEYS).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("sector", holder.alias("_t")))),
                lambda s: s["_t"],
            ),
            "; ",
        ).alias("sector_holders")
    )
    top = practice_zones.groupBy(*WEEKEND_KEYS).agg(F.max("max_speed_kmh").alias("top_speed_kmh"))
    rows = weekends
    for part in (winner, pace, sectors, top):
        rows = rows.join(part, WEEKEND_KEYS, "left")
    return rows
