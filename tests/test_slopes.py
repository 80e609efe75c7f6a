import numpy as np
import pandas as pd
import pytest

from stintwise.functions.inversions import inversion_pairs, inversion_weight, ranks_of
from stintwise.operators.slopes import theil_sen


def brute(x, y):
    slopes = [
        (y[j] - y[i]) / (x[j] - x[i])
        for i in range(len(x))
        for j in range(i + 1, len(x))
        if x[i] != x[j]
    ]
    slope = float(np.median(slopes))
    return slope, float(np.median(y - slope * x))


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(0, 50))
        values, weights = rng.integers(0, 20, n) / 7, rng.integers(1, 6, n)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if values[i] > values[j]}
        i, j = inversion_pairs(ranks_of(values))
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
        assert inversion_weight(ranks_of(values), weights) == sum(int(weights[a] * weights[b]) for a, b in want)


def groups():
    rng = np.random.default_rng(11)
    integer = lambda n: rng.integers(1, 9, n).astype(float)
    near = np.array([*np.linspace(0, 20, 60), 20 + 1e-9])
    ramp = np.arange(1.0, 16.0)
    bumped = 90 + 0.1 * ramp
    bumped[7] += 6
    shapes = {
        "tiny": (integer(4), None),
        "odd": (integer(41), None),
        "even": (integer(90), None),
        "flat": (np.full(30, 3.0), None),
        "continuous": (rng.normal(0, 5, 130), None),
        "nearly-equal": (near, None),
        "ramp": (ramp, bumped),
        "level": (np.arange(80.0), np.full(80, 7.5)),
        None: (integer(25), None),
    }
    for key, (x, y) in shapes.items():
        if y is None:
            y = np.round(80 + 0.07 * x + rng.normal(0, 0.4, len(x)), 2)
        yield key, np.concatenate([x, x[:3]]), np.concatenate([y, y[:3]])  # three points twice


@pytest.mark.parametrize(("whole", "block", "few"), [(512, 16, 40), (8, 16, 100_000), (8, 16, 60)])
def test_groups_of_any_size_equal_brute_force(spark, whole, block, few):
    """Small limits send groups over many blocks, cells and rounds."""
    frames, want = [], {}
    for key, x, y in groups():
        frames.append(pd.DataFrame({"g": key, "x": x, "y": y}))
        if key not in ("flat",):
            want[key] = (*brute(x, y), len(x))
    points = spark.createDataFrame(pd.concat(frames), "g string, x double, y double")
    got = {
        r.g: (r.slope, r.intercept, r.n_laps)
        for r in theil_sen(points, ["g"], 5, whole, block, few).collect()
    }
    assert set(got) == set(want)
    for key, (slope, intercept, n) in want.items():
        if few >= 40 and whole == 512 or few == 100_000:
            assert got[key][0] == slope
        else:  # more pairs than are listed share the middle slope of some groups
            assert got[key][0] == pytest.approx(slope, abs=1e-12)
        assert got[key][1] == pytest.approx(intercept, abs=1e-9)
        assert got[key][2] == n


@pytest.mark.parametrize("kind", ["continuous", "whole", "few-x"])
def test_one_large_group(spark, kind):
    rng = np.random.default_rng(7)
    n = 3000
    x = {"continuous": rng.normal(0, 9, n), "whole": rng.integers(0, 900, n) * 1.0, "few-x": rng.integers(0, 4, n) * 1.0}[kind]
    y = 80 + 0.07 * x + rng.standard_t(2, n)
    points = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": y}))
    row = theil_sen(points, ["g"], 5, 64, 200, 20_000).first()
    slope, intercept = brute(x, y)
    assert row.slope == slope and row.intercept == pytest.approx(intercept, abs=1e-9)


def test_buckets_of_many_rows_go_over_blocks(spark):
    """Groups of more rows than one task may hold go over blocks, and equal what one task finds."""
    frames = [pd.DataFrame({"g": key, "x": x, "y": y}) for key, x, y in groups()]
    points = spark.createDataFrame(pd.concat(frames), "g string, x double, y double")
    dealt = {r.g: r for r in theil_sen(points, ["g"], 5, 8, 16, 100_000).collect()}
    spread = {r.g: r for r in theil_sen(points, ["g"], 5, 8, 16, 100_000, held=30).collect()}
    assert set(dealt) == set(spread) == {k for k, *_ in groups()} - {"flat"}
    for key, row in dealt.items():
        assert spread[key].slope == pytest.approx(row.slope, abs=1e-12)
        assert spread[key].intercept == pytest.approx(row.intercept, abs=1e-9)
        assert spread[key].n_laps == row.n_laps


def test_ordinary_groups_are_dealt_once(spark):
    """Points of groups that one task may hold are shuffled once, by their keys, and not joined."""
    points = spark.range(4000).selectExpr("id % 500 AS g", "double(id % 8) AS x", "double(id * id % 101) AS y")
    fits = theil_sen(points, ["g"], 5)
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert fits.count() == 500
