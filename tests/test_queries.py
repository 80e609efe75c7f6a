"""A cross-section of the registered queries against their SQL on the smallest tables. The check of
all of them is tools/check_queries.py."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "landing_laps",
    "pace_laps",
    "lap_weather_asof",
    "session_results",
    "constructor_median_gaps",
    "driver_pace",
    "degradation_fits",
    "session_status",
    "sink_replace_sessions",
    "zone_speeds",
    "corner_attribution",
    "constructor_index",
    "fraction_aligned_trace",
    "car_character",
    "season_snapshot",
    "trend_gap_fill",
    "accel_scatter",
    "tolerance_match",
    "candidates_from_tables",
    "incident_events",
    "untraceable_numbers",
    "cross_doc_conflict",
    "confirmed_in_ttl",
    "change_log",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = canonical(got.toPandas())
    assert rows and rows == canonical(want)


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "year", "round", "session_type", "constructor", "median_s", "n_laps", "gap_s"
    ]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
