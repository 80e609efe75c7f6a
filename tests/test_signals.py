import pytest

from stintwise.operators import catalog as C
from stintwise.operators import corners as K
from stintwise.operators import laps as L
from stintwise.operators import pace as P
from stintwise.operators import signals as G

SIGNAL = (
    "year int, round int, signal_type string, category string, magnitude double, confidence double,"
    " subject string, locus string, session_type string, tie string, refs array<string>"
)


def signals(spark, *rows):
    return spark.createDataFrame(
        [(2025, 1, *row, None, "R", "", [f"{row[0]}:{row[4]}"]) for row in rows], SIGNAL
    )


def test_scores_within_type(spark):
    rows = signals(
        spark,
        ("a", "pace", 10.0, 1.0, "X"),
        ("a", "pace", -5.0, 1.0, "Y"),
        ("b", "pace", 20.0, 0.5, "X"),
        ("c", "result", 4.0, 1.0, "X"),
        ("d", "pace", 0.0, 1.0, "X"),
    )
    factors = spark.createDataFrame(
        [(2025, 1, "Y", 0.15)], "year int, round int, constructor string, factor double"
    )
    got = {(r.signal_type, r.subject): r.robustness for r in G.score_signals(rows, factors).collect()}
    assert got == pytest.approx(
        {("a", "X"): 1.0, ("a", "Y"): 0.075, ("b", "X"): 0.5, ("c", "X"): 0.5, ("d", "X"): 0.0}
    )


def test_fusing_and_ranking(spark):
    rows = signals(
        spark,
        ("a", "pace", 10.0, 1.0, "X"),
        ("b", "corner", 6.0, 0.5, "X"),
        ("b", "corner", 3.0, 0.5, "X"),
        ("a", "pace", 5.0, 1.0, "Y"),
        ("e", "pace", 5.0, 0.4, "Y"),
    )
    scored = G.score_signals(rows)
    ranked = G.rank_signals(G.fuse_channels(scored)).orderBy("rank").collect()
    first = ranked[0]
    assert (first.subject, first.category, first.confidence) == ("X", "cross_session", 0.75)
    assert first.robustness == pytest.approx(1.5)
    assert first.magnitude == 10.0 and len(first.refs) == 2
    assert [r.rank for r in ranked] == [1, 2, 3]
    assert [r.subject for r in ranked[1:]] == ["Y", "Y"]  # one channel: every row stays
    parts = [r.robustness for r in scored.where("subject = 'X'").collect()]
    assert first.robustness >= max(parts)


def test_expectation(spark):
    snapshot = spark.createDataFrame(
        [(2025, "A", 1), (2025, "B", 2), (2025, "C", None)],
        "year int, constructor string, overall_rank int",
    )
    actual = spark.createDataFrame(
        [(2025, 1, "A", 3), (2025, 1, "B", 2), (2025, 1, "C", 1)],
        "year int, round int, constructor string, actual_rank int",
    )
    got = {r.constructor: r.factor for r in G.expectation_factors(snapshot, actual).collect()}
    assert got == pytest.approx({"A": 1.0, "B": 0.15})


def test_corner_cap_is_inclusive(spark):
    pairs = spark.createDataFrame(
        [(2025, 1, "Q", c, "A", "B", d, "low", 0.5, 0.5, 1.0) for c, d in ((1, 18.0), (2, -18.0), (3, 18.1))],
        "year int, round int, session_type string, corner_number int, constructor_a string,"
        " constructor_b string, delta_kmh double, speed_class string, car_pct double,"
        " driver_pct double, confidence double",
    )
    got = {r.locus: r.subject for r in G.corner_delta(pairs).collect()}
    assert got == {"corner:1": "B", "corner:2": "A"}


PRINT = (
    "year int, round int, session_type string, corner_number int, driver string,"
    " constructor string, compound string, min_speed_kmh double, clean_laps int"
)


def test_attribution_split(spark):
    rows = [
        (2025, 1, "Q", 1, d, team, "SOFT", kmh, laps)
        for d, team, kmh, laps in (
            ("a1", "A", 122.0, 8), ("a2", "A", 118.0, 8), ("b1", "B", 112.0, 6), ("b2", "B", 108.0, 6),
            ("c1", "C", 130.0, 9), ("c2", "C", 131.0, 4),
        )
    ]
    rows.append((2025, 1, "Q", 1, "a1", "A", "HARD", 150.0, 4))  # too few laps to count
    got = {
        (r.constructor_a, r.constructor_b): r
        for r in K.attribution(spark.createDataFrame(rows, PRINT)).collect()
    }
    ab = got["A", "B"]
    assert ab.delta_kmh == pytest.approx(10.0)
    assert ab.car_pct == pytest.approx(10 / 14) and ab.driver_pct == pytest.approx(4 / 14)
    assert (ab.speed_class, ab.confidence) == ("low", 0.75)
    assert got["A", "C"].confidence == 0.5  # one car only: capped
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")}


LAP = (
    "year int, round int, session_type string, driver string, constructor string, lap_number int,"
    " stint_number int, tyre_age int, compound string, lap_time_s double, is_accurate boolean,"
    " deleted boolean, track_status string, is_outlap boolean, is_inlap boolean, rainfall boolean,"
    " position int, session_time_s double"
)


def lap(n, t, driver="VER", session="Q", **changes):
    row = {
        "year": 2025, "round": 1, "session_type": session, "driver": driver, "constructor": "A",
        "lap_number": n, "stint_number": 1, "tyre_age": n, "compound": "SOFT", "lap_time_s": t,
        "is_accurate": True, "deleted": False, "track_status": "1", "is_outlap": False,
        "is_inlap": False, "rainfall": False, "position": 1, "session_time_s": 90.0 * n,
    }
    return tuple({**row, **changes}.values())


def test_stint_keeps_only_pace_laps(spark):
    rows = spark.createDataFrame(
        [
            lap(1, 99.0, is_outlap=True, compound=None),
            lap(2, 90.0, track_status=None),
            lap(3, 91.0),
            lap(4, 95.0, track_status="4"),
            lap(5, 88.0, deleted=True),
            lap(6, 97.0, is_inlap=True),
        ],
        LAP,
    )
    got = L.stint_summary(L.gap_to_car_ahead(rows)).collect()[0]
    assert (got.lap_start, got.lap_end, got.kept_laps, got.compound) == (1, 6, 2, "SOFT")
    assert got.avg_pace_s == 90.5


def test_stints_need_no_car_ahead(spark):
    rows = spark.createDataFrame(
        [lap(n, 90.0 + p, d, "R", position=p, session_time_s=90.0 * n + 2 * (p - 1))
         for n in range(1, 9) for d, p in (("VER", 1), ("NOR", 2))],
        LAP,
    )
    plain, grouped = L.gap_to_car_ahead(rows), L.gap_to_car_ahead(rows, prunable=True)
    assert sorted(plain.collect()) == sorted(grouped.collect())
    assert sorted(L.stint_summary(plain).collect()) == sorted(L.stint_summary(grouped).collect())
    plan = L.stint_summary(grouped)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "_ahead_s" not in plan


def test_fuel_and_gaps_and_opening_lap(spark):
    rows = spark.createDataFrame(
        [lap(n, 90.0, d, "R", position=p, session_time_s=90.0 * n + 2 * (p - 1))
         for n in range(1, 71) for d, p in (("VER", 1), ("NOR", 2))],
        LAP,
    )
    gaps = L.gap_to_car_ahead(rows)
    assert {r.gap_s for r in gaps.where("driver = 'VER'").collect()} == {None}
    assert {r.gap_s for r in gaps.where("driver = 'NOR'").collect()} == {2.0}
    kept = L.pace_laps(gaps)
    first = kept.where("lap_number = 1 and driver = 'VER'").collect()[0]
    assert first.pace_s == pytest.approx(90 - 0.025 * 69)
    paced = L.without_opening_lap(kept, rows)
    assert paced.count() == kept.count() - 2
    marked = L.mark_opening_lap(kept, rows)
    assert marked.where("opening").count() == 2


def test_box_with_outlier(spark):
    rows = spark.createDataFrame(
        [lap(i, float(v), pace_s=float(v)) for i, v in enumerate((1, 2, 3, 4, 100), 1)],
        LAP + ", pace_s double",
    )
    box = P.box_stats(rows, P.TEAM_KEYS).collect()[0]
    assert (box.median_s, box.whisker_low_s, box.whisker_high_s) == (3.0, 1.0, 4.0)
    assert (box.n_outliers, box.mean_s, box.compounds) == (1, 22.0, "S")
    assert [r.pace_s for r in P.outlier_laps(rows, P.TEAM_KEYS).collect()] == [100.0]


def test_result_casts_and_gaps(spark):
    rows = spark.createDataFrame(
        [
            (2025, 1, "R", "a", "A", "1", 57.0, "Finished", 5400.0, 1.0, None, None),
            (2025, 1, "R", "b", "A", "2", 57.0, "Finished", 3.25, None, None, None),
            (2025, 1, "R", "c", "B", "3", 56.0, "Lapped", 9.0, None, None, None),
            (2025, 1, "R", "d", "B", "NC", 10.0, "Retired", None, None, None, None),
        ],
        "year int, round int, session_type string, driver string, constructor string,"
        " position string, laps double, status string, time_s double, q1_time_s double,"
        " q2_time_s double, q3_time_s double",
    )
    got = {r.driver: r for r in C.session_results(rows).collect()}
    assert got["a"].gap_to_leader_s == 0.0 and got["a"].total_time_s == 5400.0
    assert got["b"].gap_to_leader_s == 3.25 and got["b"].total_time_s is None
    assert got["c"].gap_to_leader_s is None
    assert got["d"].position is None and got["a"].q1_time_s is None
