"""Signal mining, scoring and ranking queries."""

from pyspark.sql import functions as F

from stintwise.constants import SESSION_KEYS, WEEKEND_KEYS
from stintwise.operators import corners as K
from stintwise.operators import reads as R
from stintwise.operators import season as N
from stintwise.operators import signals as G
from stintwise.plans.columns import rounded
from stintwise.plans.registry import query

FIELDS = """year, round, signal_type, category, round(magnitude, 6) AS magnitude, round(confidence, 6) AS confidence,
subject, locus, session_type, tie"""
COLUMNS = [*WEEKEND_KEYS, *G.COLUMNS[:-1]]
NAMED = """(SELECT NULL::INT AS year, NULL::INT AS round, NULL::VARCHAR AS signal_type, NULL::VARCHAR AS category, NULL::DOUBLE AS magnitude,
NULL::DOUBLE AS confidence, NULL::VARCHAR AS subject, NULL::VARCHAR AS locus, NULL::VARCHAR AS session_type, NULL::VARCHAR AS tie WHERE false
UNION ALL SELECT * FROM {cte})"""


def sig_sql(cte: str) -> str:
    return f"SELECT {FIELDS} FROM {NAMED.format(cte=cte)}"


def shown(df):
    return rounded(df.select(*COLUMNS))


@query("sig_corner_delta", sig_sql("sig_corner"))
def _(t):
    return shown(G.corner_delta(t.pairs))


@query("sig_straight_delta", sig_sql("sig_straight"))
def _(t):
    return shown(G.straight_delta(t.zones))


@query("sig_pace", sig_sql("sig_pace"))
def _(t):
    return shown(G.pace_deficit(t.team_pace))


@query("sig_clean_air", sig_sql("sig_clean"))
def _(t):
    return shown(G.clean_air_shift(t.clean_air))


@query("sig_position_swing", sig_sql("sig_swing"))
def _(t):
    return shown(G.position_swing(t.results, "Q", "R", "position_swing"))


@query("sig_sector_delta", sig_sql("sig_sector"))
def _(t):
    return shown(G.sector_delta(t.sector_bests))


@query("sig_quali_top_speed", sig_sql("sig_top"))
def _(t):
    return shown(
        G.quali_deficit(G.quali_reps(t.quali_rows), "top_speed_kmh", "quali_top_speed_delta")
    )


@query("sig_quali_grip", sig_sql("sig_grip"))
def _(t):
    return shown(G.quali_deficit(G.quali_reps(t.quali_rows), "min_speed_kmh", "quali_grip_delta"))


@query("sig_quali_progression", sig_sql("sig_progress"))
def _(t):
    return shown(G.quali_progression(t.results))


@query("sig_pace_speed_residual", sig_sql("sig_residual"))
def _(t):
    return shown(G.pace_speed_residual(G.quali_reps(t.quali_rows)))


@query("sig_deployment_clip", sig_sql("sig_clip"))
def _(t):
    return shown(G.deployment_clip(t.clips))


@query("sig_ers_character", sig_sql("sig_ers"))
def _(t):
    return shown(G.ers_character(t.accel))


@query("sig_degradation", sig_sql("sig_wear"))
def _(t):
    return shown(G.degradation(t.wear))


@query("sig_sprint_vs_race", sig_sql("sig_sprint"))
def _(t):
    return shown(G.sprint_race_delta(t.team_pace))


@query("all_signals", f"SELECT {FIELDS} FROM sig")
def _(t):
    return shown(t.signals)


@query("actual_ranks", "SELECT year, round, constructor, actual_rank, best_position FROM actual")
def _(t):
    return G.actual_ranks(t.results)


@query("expected_ranks", "SELECT year, constructor, overall_rank AS expected_rank FROM snapshot WHERE overall_rank IS NOT NULL")
def _(t):
    return t.season_snapshot().where(F.col("overall_rank").isNotNull()).select(
        "year", "constructor", F.col("overall_rank").alias("expected_rank")
    )


@query(
    "expectation_factor",
    "SELECT year, round, constructor, expected_rank, actual_rank, round(factor, 6) AS factor FROM factors",
)
def _(t):
    return rounded(G.expectation_factors(t.snapshot, G.actual_ranks(t.results)))


def scored(t):
    factors = G.expectation_factors(t.snapshot, G.actual_ranks(t.results))
    return t.stored("scored", lambda: G.score_signals(t.signals, factors))


@query("score_signals", f"SELECT {FIELDS}, round(robustness, 6) AS robustness FROM scored")
def _(t):
    factors = G.expectation_factors(t.snapshot, G.actual_ranks(t.results))
    return rounded(
        G.score_signals(t.signals, factors).select(*COLUMNS, "robustness")
    )


@query(
    "fuse_channels",
    f"SELECT {FIELDS}, round(robustness, 6) AS robustness, CAST(n_refs AS INT) AS n_refs FROM fused",
)
def _(t):
    fused = G.fuse_channels(scored(t)).withColumn("n_refs", F.size("refs"))
    return rounded(fused.select(*COLUMNS, "robustness", "n_refs"))


RANKED = f"SELECT {FIELDS}, round(robustness, 6) AS robustness, rank FROM ranked"


@query("rank_signals", RANKED)
def _(t):
    ranked = G.rank_signals(G.fuse_channels(scored(t)))
    return rounded(ranked.select(*COLUMNS, "robustness", "rank"))


@query("candidates_from_tables", RANKED)
def _(t):
    ranked = G.candidates(t.signals, t.snapshot, t.results)
    return rounded(ranked.select(*COLUMNS, "robustness", "rank"))


@query("top_candidates", f"SELECT * FROM ({RANKED}) WHERE rank <= 10")
def _(t):
    ranked = t.stored(
        "ranked", lambda: G.rank_signals(G.fuse_channels(scored(t)))
    )
    return rounded(G.top_candidates(ranked, 10).select(*COLUMNS, "robustness", "rank"))


@query(
    "candidates",
    f"SELECT {FIELDS}, round(robustness, 6) AS robustness, rank, CAST(n_refs AS INT) AS n_refs FROM ranked",
)
def _(t):
    ranked = G.candidates(t.signals, t.snapshot, t.results)
    return rounded(
        ranked.select(*COLUMNS, "robustness", "rank", F.size("refs").alias("n_refs"))
    )


@query(
    "grid_vs_finish",
    """SELECT r.year, r.round, r.driver, r.constructor, r.position AS finish, q.position AS grid, q.position - r.position AS swing
    FROM results r JOIN results q ON r.year = q.year AND r.round = q.round AND r.driver = q.driver
    WHERE r.session_type = 'R' AND q.session_type = 'Q' AND abs(q.position - r.position) >= 2""",
)
def _(t):
    return R.grid_vs_finish(t.results)


@query(
    "sprint_vs_race",
    """SELECT year, round, constructor, round(a.gap_s, 6) AS sprint_gap_s, round(b.gap_s, 6) AS race_gap_s, round(a.gap_s - b.gap_s, 6) AS delta_s
    FROM (SELECT * FROM team_pace WHERE session_type = 'SPRINT') a JOIN (SELECT * FROM team_pace WHERE session_type = 'R') b USING (year, round, constructor)
    WHERE a.gap_s - b.gap_s <> 0""",
)
def _(t):
    return rounded(R.sprint_vs_race(t.team_pace))


@query(
    "race_deployment_character",
    """SELECT year, round, constructor, round(slope, 6) AS slope, n_points, round(a, 6) AS accel_at_150_ms2, round(b, 6) AS accel_at_250_ms2,
      round(avg(a) OVER w, 6) AS field_at_150_ms2, round(avg(b) OVER w, 6) AS field_at_250_ms2, count(*) OVER w AS n_constructors,
      CAST(row_number() OVER (PARTITION BY year, round ORDER BY b DESC, constructor) AS INT) AS place
    FROM (SELECT *, slope * 150 + intercept AS a, slope * 250 + intercept AS b FROM band_fits) WINDOW w AS (PARTITION BY year, round)
    QUALIFY n_constructors >= 3""",
)
def _(t):
    return rounded(N.race_deployment_character(t.accel))


@query(
    "common_constructors",
    """SELECT year, round, constructor FROM team_pace WHERE session_type = 'SPRINT'
    INTERSECT SELECT year, round, constructor FROM team_pace WHERE session_type = 'R'""",
)
def _(t):
    of = lambda s: t.team_pace.where(F.col("session_type") == s).select(
        *WEEKEND_KEYS, "constructor"
    )
    return of("SPRINT").intersect(of("R"))


@query(
    "all_constructors",
    """SELECT year, round, constructor FROM race_team_pace UNION SELECT year, round, constructor FROM driver_corner""",
)
def _(t):
    return (
        t.race_pace.select(*WEEKEND_KEYS, "constructor")
        .union(K.driver_corners(t.prints).select(*WEEKEND_KEYS, "constructor"))
        .distinct()
    )


@query(
    "constructors_not_run",
    """SELECT DISTINCT year, round, session_type, constructor FROM laps EXCEPT
    SELECT year, round, session_type, constructor FROM wear WHERE compound = 'SOFT'""",
)
def _(t):
    ran = t.wear.where(F.col("compound") == "SOFT").select(*SESSION_KEYS, "constructor")
    every = t.laps.select(*SESSION_KEYS, "constructor").distinct()
    return every.join(ran, [*SESSION_KEYS, "constructor"], "left_anti")
