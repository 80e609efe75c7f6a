import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintwise.functions import skew
from stintwise.operators import laps as L
from stintwise.plans.marts import PACE, Marts
from stintwise.sources.landing import HELD, land_laps
from stintwise.streaming.ingest import land

LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)
KEYS = ["year", "round", "session_type", "driver"]


@pytest.fixture(scope="module")
def lines():
    """One driver holds most rows; dates, quantities and flags may be missing."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        day = dt.datetime(1995, 1, 1) + dt.timedelta(days=int(rng.integers(0, 720)))
        rows.append(
            (
                i,
                i % 7,
                1 if i % 3 else int(rng.integers(2, 9)),
                i % 4,
                None if i % 41 == 40 else float(rng.integers(1, 50)),
                None if i % 29 == 0 else float(rng.integers(0, 11)) / 100,
                None if i % 31 == 0 else float(rng.integers(0, 9)) / 100,
                [None, "R", "A"][i % 3],
                [None, "F", "O"][i % 5 % 3],
                None if i % 50 == 0 else day,
            )
        )
    return rows


def plain(lines):
    """The laps worked out row by row."""
    out = []
    for o, p, s, n, q, d, t, flag, status, day in lines:
        if day is None or s == 8:
            continue
        if (day.month - 1) // 3 in (0, 2):
            kind = "FP1" if status == "F" else "Q"
        else:
            kind = "SPRINT" if flag == "R" else "R"
        out.append((day.year, 1 if day.month <= 6 else 2, kind, s, day, o, n, p, q, d, t, flag))
    names = [*KEYS, "day", "o", "n", "p", "q", "d", "t", "flag"]
    df = pd.DataFrame(out, columns=names).sort_values([*KEYS, "day", "o", "n", "p"], ignore_index=True)
    df["lap_number"] = df.groupby(KEYS).cumcount() + 1
    df["stint_number"] = (df.lap_number - 1) // 8 + 1
    df["tyre_age"] = (df.lap_number - 1) % 8 + 1
    df["lap_time_s"] = (80 + df.q / 10 + 0.05 * df.tyre_age).round(3)
    df["accurate"] = [None if pd.isna(d) else round(d * 100) < 10 for d in df.d]
    df["deleted"] = [
        False if (t is not None and not pd.isna(t) and round(t * 100) != 8) or (f is not None and f != "R")
        else None if pd.isna(t) or f is None else True
        for t, f in zip(df.t, df.flag)
    ]
    df["session_time_s"] = df.groupby(KEYS).lap_time_s.transform(lambda x: x.fillna(0).cumsum()).round(3)
    return df


@pytest.mark.parametrize("held", [HELD, 20, 0])
def test_laps_by_plain_rules(spark, lines, held):
    """All drivers by one task each, the busy one over blocks, all over blocks."""
    teams = spark.createDataFrame([(i, f"team {i % 3}") for i in range(1, 8)], "driver long, constructor string")
    laps = land_laps(spark.createDataFrame(lines, LINES), teams, held)
    got = laps.toPandas().sort_values([*KEYS, "lap_number"], ignore_index=True)
    want = plain(lines)
    assert len(got) == len(want) and (got.constructor == "team " + (got.driver % 3).astype(str)).all()
    for name in (*KEYS, "lap_number", "stint_number", "tyre_age"):
        assert got[name].tolist() == want[name].tolist()
    for mine, theirs in (("is_accurate", "accurate"), ("deleted", "deleted")):
        assert [None if pd.isna(x) else bool(x) for x in got[mine]] == [
            None if x is None or pd.isna(x) else bool(x) for x in want[theirs]
        ]
    known = want.lap_time_s.notna()
    assert np.allclose(got.lap_time_s[known], want.lap_time_s[known]) and got.lap_time_s[~known].isna().all()
    timed = got.session_time_s.notna()
    assert np.allclose(got.session_time_s[timed], want.session_time_s[timed], atol=1e-3)
    placed = got.assign(clock=got.session_time_s.fillna(-1)).sort_values(["clock", "driver"])
    order = placed.groupby(["year", "round", "session_type", "lap_number"]).cumcount() + 1
    assert (got.position == order.sort_index()).all()


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("hashpartitioning") + plan.count("rangepartitioning")


def test_numbered_rows_and_laps_are_not_dealt_again(spark, lines):
    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    assert shuffles(skew.row_numbers(rows, ["k"], [F.col("id")], "n")) == 0
    teams = spark.createDataFrame([(i, "t") for i in range(1, 8)], "driver long, constructor string")
    assert shuffles(land_laps(spark.createDataFrame(lines, LINES), teams)) == 0


def test_totals_of_sessions_go_to_the_laps(spark):
    """Whatever Spark takes their size to be, the laps stay where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laps = spark.createDataFrame(
            [(2025, 1, "R", n, 90.0) for n in range(1, 9)],
            "year int, round int, session_type string, lap_number int, lap_time_s double",
        )
        found = L.fuel_corrected(laps)
        assert shuffles(found) == 1 and {r["total_laps"] for r in found.collect()} == {8}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_row_numbers_of_null_keys(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5), (None, 2)], "k string, v int")
    got = {(r["k"], r["v"]): r["n"] for r in skew.row_numbers(rows, ["k"], [F.col("v")], "n").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (None, 3): 3, ("a", 2): 1, ("a", 5): 2}


def test_rows_that_lie_by_session_are_landed_as_they_lie(spark, tmp_path):
    """A file for each file that was there: no row is dealt anew."""
    rows = spark.range(0, 40, 1, 4).select(
        F.lit(2025).alias("year"),
        F.lit(1).alias("round"),
        F.when(F.col("id") < 20, "Q").otherwise("R").alias("session_type"),
        F.col("id").alias("driver"),
    )
    land(rows, str(tmp_path / "landing"), ranged=True)
    found = spark.read.parquet(str(tmp_path / "landing"))
    assert found.count() == 40 and len(found.inputFiles()) == 4


def test_the_pace_table_holds_what_pace_is_read_by(spark):
    tables = Marts.of(spark, "/root/testdata/sf0.001")
    assert set(tables.pace_table.columns) == {*PACE, "opening"}
    assert not any("session_type=" in f for f in tables.pace_table.inputFiles())
