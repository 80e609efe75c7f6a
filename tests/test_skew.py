import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stintwise.functions import skew


@pytest.fixture(scope="module")
def lopsided(spark):
    """One group holds most rows, many of them equal."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(6000) < 0.7, "hot", rng.choice(list("abcdef"), 6000))
    value = np.where(rng.random(6000) < 0.3, 80.25, np.round(rng.normal(85, 6, 6000), 3))
    return pd.DataFrame({"k": key, "v": value, "id": np.arange(6000)})


@pytest.mark.parametrize("gathered", [20_000, 1000, 0])
def test_quantiles_match_numpy(spark, lopsided, gathered):
    """All groups gathered, all but the large one, none."""
    probs = {"low": 0.1, "q1": 0.25, "mid": 0.5, "top": 1.0}
    got = skew.exact_quantiles(
        spark.createDataFrame(lopsided), ["k"], "v", probs, "n", gathered=gathered
    ).toPandas()
    assert len(got) == 7
    for row in got.itertuples():
        values = lopsided.loc[lopsided.k == row.k, "v"]
        assert row.n == len(values)
        for name, p in probs.items():
            assert getattr(row, name) == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_worked_quantiles(spark):
    rows = spark.createDataFrame(
        [("a", float(v)) for v in (90, 91, 92, 93)] + [("b", float(v)) for v in range(1, 6)],
        "k string, v double",
    )
    got = {
        r.k: r
        for r in skew.exact_quantiles(
            rows, ["k"], "v", {"q1": 0.25, "q3": 0.75, "low": 0.1}
        ).collect()
    }
    assert (got["a"].q1, got["a"].q3) == (90.75, 92.25)
    assert got["b"].low == pytest.approx(1.4)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-50, 50, allow_nan=False), min_size=1, max_size=40))
def test_quantile_of_any_values(spark, values):
    rows = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    got = skew.exact_quantiles(rows, ["k"], "v", {"m": 0.5}).collect()[0].m
    assert got == pytest.approx(float(np.median(values)), abs=1e-9)


def test_weights_null_keys_and_null_values(spark):
    rows = [(None, 1.0, 3), (None, 5.0, 1), ("a", 2.0, 1), ("a", None, 9), ("b", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    for gathered in (100, 1):
        found = skew.exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, "n", "w", gathered)
        got = {r.k: (r.m, pytest.approx(r.q), r.n) for r in found.collect()}
        assert got == {None: (1.0, 3.8, 4), "a": (2.0, 2.0, 1)}


@pytest.fixture
def no_merging(spark):
    """Small ranges stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_row_numbers_with_merged_ranges(spark, lopsided):
    test_row_numbers_span_blocks(spark, lopsided, None)


def test_row_numbers_span_blocks(spark, lopsided, no_merging):
    rows = spark.createDataFrame(lopsided)
    got = skew.row_numbers(rows, ["k"], [F.col("v"), F.col("id")], "n").toPandas()
    want = lopsided.sort_values(["v", "id"]).groupby("k").cumcount() + 1
    assert (got.set_index("id").n.sort_index() == want.sort_index()).all()


def test_hot_group_is_split_over_blocks(spark, lopsided, no_merging):
    blocked = skew.blocks(spark.createDataFrame(lopsided), ["k"], [F.col("v"), F.col("id")])
    hot = blocked.where("k = 'hot'").select("_block").distinct().count()
    assert hot > 3


def test_attach_and_first(spark, lopsided):
    rows = spark.createDataFrame(lopsided)
    got = skew.attach(rows, ["k"], F.max("v").alias("m")).toPandas()
    want = lopsided.groupby("k").v.max()
    assert (got.m == got.k.map(want)).all()
    first = skew.first_by(rows, ["k"], "v", "id").toPandas().set_index("k").id
    assert (first == lopsided.sort_values(["v", "id"]).groupby("k").id.first()).all()


def test_gap_to_best_plans_agree(spark, lopsided):
    rows = spark.createDataFrame(lopsided.groupby("k", as_index=False).first().assign(s=1))
    few = skew.gap_to_best(rows, ["s"], "v", "gap", few=True).toPandas()
    many = skew.gap_to_best(rows, ["s"], "v", "gap", few=False).toPandas()
    key = lambda d: d.sort_values("k").gap.tolist()
    assert key(few) == key(many)


def test_a_group_of_near_values_spans_many_tasks(spark, no_merging):
    """All values of the group lie within a thousandth."""
    rows = spark.range(0, 40_000, 1, 8).select(
        F.lit("k").alias("k"), (F.lit(80.0) + F.pmod(F.col("id") * 7919, F.lit(40_000)) * 2.5e-8).alias("v")
    )
    ranged = skew.blocks(rows, ["k"], [F.col("v")])
    assert ranged.groupBy("_block").count().count() >= 8
    got = skew.exact_quantiles(rows, ["k"], "v", {"m": 0.5}, "n").first()
    assert got.n == 40_000 and got.m == pytest.approx(80.0 + 19_999.5 * 2.5e-8, abs=1e-12)


@pytest.mark.parametrize("merging", [True, False])
def test_neighbours_by_brute_force(spark, merging):
    rng = np.random.default_rng(6)
    left = [(int(i), None if g == 3 else int(g), float(t)) for i, (g, t) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 500, 300)))]
    right = [(None if g == 3 else int(g), float(t) if t % 11 else None, f"v{j}") for j, (g, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60)))]
    right += [(0, 250.0, "same-a"), (0, 250.0, "same-b"), (1, 3.0, None)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(merging).lower())
    try:
        found = skew.neighbours(
            spark.createDataFrame(left, "id int, g int, at double"),
            spark.createDataFrame(right, "g int, at double, v string"),
            ["g"],
            "at",
            F.col("v"),
            "below",
            "above",
        ).collect()
    finally:
        spark.conf.unset(name)
    got = {r.id: (r.below, r.above) for r in found}
    assert len(found) == len(left)
    for i, g, t in left:
        mine = sorted(((a, v or "") for h, a, v in right if h == g and a is not None), key=lambda r: r)
        below = [r for r in mine if r[0] <= t]
        above = [r for r in mine if r[0] >= t]
        want_below = below[-1][1] if below else ""
        want_above = max(v for a, v in above if a == above[0][0]) if above else ""
        assert (got[i][0] or "", got[i][1] or "") == (want_below, want_above)
