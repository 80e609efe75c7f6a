from stintwise.operators import laps as L
from stintwise.operators import pace as P
from stintwise.operators import reads as R
from stintwise.operators import text as T

SESSION = (2025, 1, "R")


def test_a_result_with_very_many_stints_stays_one_row(spark):
    results = spark.createDataFrame(
        [(*SESSION, 4, 1, None, 50.0, 50, 50, "Finished")],
        "year int, round int, session_type string, driver int, position long, gap_to_leader_s double, "
        "total_time_s double, laps long, leader_laps long, status string",
    )
    stints = spark.createDataFrame(
        [(*SESSION, 4, n, "SOFT" if n % 2 else "HARD") for n in range(1, 131)],
        "year int, round int, session_type string, driver int, stint_number int, compound string",
    )
    (row,) = R.stint_result_join(results, stints).collect()
    assert row["strategy"] == "-".join("S" if n % 2 else "H" for n in range(1, 131))


def test_the_last_weather_reading_holds_to_the_end(spark):
    readings = [(0.0, False), (60.0, True), (2000.0, False)]
    weather = spark.createDataFrame(
        [(*SESSION, t, r) for t, r in readings],
        "year int, round int, session_type string, time_s double, rainfall boolean",
    )
    ends = [-5.0, 0.0, 59.0, 60.0, 700.0, 1300.0, 1999.0, 2000.0, 3000.0, 90_000.0]
    laps = spark.createDataFrame(
        [(*SESSION, i, t) for i, t in enumerate(ends)],
        "year int, round int, session_type string, lap int, session_time_s double",
    )
    got = {r["session_time_s"]: r["rain_at_end"] for r in L.weather_asof(laps, weather).collect()}
    for end in ends:
        before = [r for t, r in readings if t <= end]
        assert got[end] == (before[-1] if before else None)


def test_laps_without_a_constructor_are_a_group(spark):
    laps = spark.createDataFrame(
        [(*SESSION, "a", 90.0), (*SESSION, None, 91.0), (*SESSION, None, 93.0)],
        "year int, round int, session_type string, constructor string, pace_s double",
    )
    got = {r["constructor"]: (r["median_s"], r["n_laps"]) for r in P.constructor_median_gaps(laps).collect()}
    assert got == {"a": (90.0, 1), "?": (92.0, 2)}


def test_json_items_ask_for_the_key_not_the_value(spark):
    texts = spark.createDataFrame(
        [(1, 'x [{"header": null, "n": 1}]'), (2, '[{"other": "v"}]'), (3, '[{"header": "h"}, 4]')],
        "id int, text string",
    )
    good, bad = T.parsed_items(texts, ["header"], 1)
    assert {(r["id"], r["header"]) for r in good.collect()} >= {(1, None)}
    assert 2 in {r["id"] for r in bad.collect()}


def test_sector_bests_compare_numbers_before_names(spark):
    kinds = (
        "year int, round int, session_type string, driver bigint, constructor string, deleted boolean, "
        "sector1_s double, sector2_s double, sector3_s double"
    )
    key = (2024, 1, "R", 1)
    laps = [
        (*key, "B", False, 30.0, 40.0, None),
        (*key, "A", None, None, 39.5, None),
        (*key, None, False, 29.0, None, None),
        (*key, "A", True, 1.0, 1.0, 1.0),
        (2024, 1, "R", None, None, False, None, None, 20.0),
        (2024, 1, "R", None, None, False, None, None, 20.0),
        (2024, 1, "R", 2, "C", False, None, None, None),
    ]
    best = L.sector_bests(spark.createDataFrame(laps, kinds))
    found = sorted(map(tuple, best.collect()), key=str)
    assert found == [
        (*key, 1, "B", 29.0),
        (*key, 2, "A", 39.5),
        (2024, 1, "R", None, 3, None, 20.0),
    ]
    plan = best._jdf.queryExecution().sparkPlan().toString()
    over_laps = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in over_laps  # a sort of every lap's sectors spilled
