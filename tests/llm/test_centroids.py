import hashlib
import math
import random

import numpy as np
import pytest

from stintwise.llm import centroids as K

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, count=40, rounds=5, seed=2):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    mark = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    at = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in kept]
        for c in set(to):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == c]
            at[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(
        (str(i), c, d, sum(e for e, f in last if f == c), sum(e for e, _ in last), marks[c])
        for (i, _), (d, c) in zip(kept, last, strict=True)
    )


def got(spark, rows, schema=SCHEMA, **options):
    out = K.clusters(spark.createDataFrame(rows, schema).repartition(3), **options)
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def cloud(seed, count, spread=0.3, centres=6):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(centres)]
    return [
        (i, [m + draw.gauss(0, spread) for m in middles[min(draw.randrange(centres + 3), centres - 1)]])
        for i in range(count)
    ]


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_equals_brute_force(spark, spread):
    rows = cloud(1, 160, spread)
    assert got(spark, rows, count=9, rounds=3) == brute(rows, 9, 3)


def test_ties_repeated_rows_and_empty_clusters(spark):
    draw = random.Random(5)
    corners = [[float(draw.randrange(2)) for _ in range(64)] for _ in range(4)]
    rows = [(i % 30, corners[i % 4]) for i in range(60)] + [(7, [0.5] * 64)] * 3
    assert got(spark, rows, count=12, rounds=2) == brute(rows, 12, 2)


def test_vectors_that_take_no_part(spark):
    rows = cloud(2, 20)
    odd = [
        (100, None),
        (101, []),
        (102, [1.0] * 63),
        (103, [1.0] * 65),
        (104, [None] + [0.0] * 63),
        (105, [math.nan] + [0.0] * 63),
        (106, [math.inf] + [0.0] * 63),
        (None, [0.25] * 64),
    ]
    assert got(spark, rows + odd, count=40, rounds=1) == brute(rows + odd, 40, 1)
    assert got(spark, odd[:-1]) == [] and got(spark, []) == []


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, v, "x", 7, 3) for i, v in cloud(3, 12)]
    schema = SCHEMA + ", vector string, cells int, cluster int"
    assert got(spark, rows, schema, count=3, rounds=1) == brute([r[:2] for r in rows], 3, 1)


def test_components_whose_squares_pass_64_bits(spark):
    rows = [(i, [2.0**40 + i % 3] * 64) for i in range(9)] + [(50, [0.0] * 64), (51, [1.0] * 64)]
    assert got(spark, rows, count=11, rounds=1) == brute(rows, 11, 1)
    with pytest.raises(Exception, match="too large"):
        got(spark, [(1, [2.0**60] * 64)])


def test_cells_bound_every_distance_and_spare_vectors():
    draw = np.random.default_rng(4)
    rows = draw.integers(-200, 200, (500, 64)) + draw.integers(0, 5, (500, 1)) * 400
    at = rows[:7]
    inner = np.sort(rows[:100], axis=0)[[i * 100 // 16 for i in range(1, 16)]].T
    least, most = K.interval_tables(at, inner, rows.min(axis=0), rows.max(axis=0))
    cells = np.stack([np.searchsorted(inner[d], rows[:, d], side="right") for d in range(64)], 1)
    pairs = cells[:, ::2] | cells[:, 1::2] << 4
    start = sum(least[p][pairs[:, p]] for p in range(32))
    end = sum(most[p][pairs[:, p]] for p in range(32))
    far = ((rows[:, None, :] - at[None]) ** 2).sum(axis=2)
    assert (start <= far).all() and (far <= end).all()
    import pyarrow as pa

    chooser = K.Assigner(at, inner, rows.min(axis=0), rows.max(axis=0))
    found = chooser.nearest(pairs.astype(np.uint8), pa.array(rows.tolist()))
    assert (found == far.argmin(axis=1)).all()
    assert chooser.fetched < len(rows)
