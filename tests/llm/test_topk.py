import math
import random

import pytest

from stintwise.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, score int, rank string"


def brute(rows, k):
    real = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in sorted({i: a for i, a in sorted(real, key=lambda r: r[1], reverse=True)}.items()):
        if q % 20:
            continue
        found = [
            (-sum(x * y for x, y in zip(a, b, strict=True)), i)
            for i, b in real
            if i != q and len(a) == len(b)
        ]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus():
    rng = random.Random(8)
    f32 = lambda x: math.ldexp(round(x * 2**16), -16)  # noqa: E731  exact as 32-bit floats
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(6)]) for i in range(300)]
    same = rows[3][1]
    rows += [(400 + i, list(same)) for i in range(60)]  # ties beyond k
    rows += [(900, [3.0, -500.0, 0.25, 1.0, 0.0, 0.5]), (921, None), (922, [1.0, None, 0, 0, 0, 0])]
    rows += [(940, [float("nan")] * 6), (941, [float("inf")] * 6), (None, same), (960, [1.0, 2.0])]
    rows += [(961, [0.5, 0.5]), (980, []), rows[40], rows[40], rows[7]]
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]


def test_ranks_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], SCHEMA).repartition(5)
    for k in (1, 20):
        got = sorted(map(tuple, top_k(df, k).collect()))
        assert got == brute(rows, k)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k(df).collect() == []


def test_groups_of_queries(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, top_k(df, 3, group_bytes=200).collect())) == brute(rows, 3)


def test_large_components_are_exact_and_too_large_scores_an_error(spark):
    rows = [(20, [2.0**50, 0.0, 1.0]), (40, [0.0, 2.0**70, 1.0]), (1, [2.0**-6, 0.0, 3.0])]
    rows += [(2, [-(2.0**-6), 0.0, 2.0**40]), (60, [0.0, 0.0, 0.25]), (3, [0.25, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 4).collect())) == brute(rows, 4)
    wide = [(20, [2.0**40]), (1, [2.0**40])]  # 2**92
    with pytest.raises(Exception, match="leaves 64 bits"):
        top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
