"""Theil-Sen slopes per group, exact, in n log n for groups of any size.

The number of slopes below s among points in x order is the number of inversions of y - s * x. The middle
slope of a group is bracketed by such counts, fifteen trial slopes a round, until few slopes are left
between the ends; those are the inversions between the orders at both ends, listed at the cost of their
number. No pair of points or of blocks is formed besides.

A count is taken over blocks. Points lie in blocks by x; each block sorts its points by y - s * x and
cuts them into cells by splitters from a sample. Inversions inside a block are counted there, those
inside a cell where its pieces meet, and all others follow from the numbers of points per block and cell.

Groups of up to `HELD` rows, the ordinary case, are dealt by their keys once, are one row each and are
solved where they stand: over all pairs up to `WHOLE` distinct points, else by the same brackets and counts.
"""

from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from stintwise.functions.inversions import inversion_pairs, inversion_weight, ranks_of
from stintwise.functions.skew import exact_quantiles, work_table

WHOLE = 512
BUCKETS = 8192
HELD = 200_000  # rows of a bucket of groups up to which each of its groups may lie in one task
BLOCK = 16_384  # distinct points of a block, about
MOST_BLOCKS = 1024
SAMPLE = 512  # points of a group that trial slopes and splitters are taken from, about
FEW = 1_000_000  # slopes between two ends that are listed
TRIALS = 15
WIDEST = 1e30


@cache
def pairs(count: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(count, 1)


def weighted_middle(values: np.ndarray, weights: np.ndarray) -> float:
    """The median of values that stand for `weights` equal ones each."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    low, high = values[order[np.searchsorted(upto, [(upto[-1] + 1) // 2, upto[-1] // 2 + 1])]]
    return float((low + high) / 2) if low != high else float(low)


def sample_slopes(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, weights) between points of distinct x."""
    i, j = pairs(len(x))
    dx = x[j] - x[i]
    real = dx != 0
    i, j = i[real], j[real]
    return (y[j] - y[i]) / dx[real], n[i] * n[j]


def points_of(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """x, y and n of all rows of a column of point lists, and where each row's points end."""
    flat = column.flatten()
    x, y, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    ends = column.offsets.to_numpy()[1:] - column.offsets.to_numpy()[0]
    return [x, y, n], ends


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, whole: int, few: int) -> tuple[float, float] | None:
    """(slope, intercept) of one group, None if its points have one x."""
    if len(x) <= whole:
        slopes, weights = sample_slopes(x, y, n)
        slope = weighted_middle(slopes, weights) if len(slopes) else None
    else:
        slope = bracketed(x, y, n, few)
    return None if slope is None else (slope, weighted_middle(y - slope * x, n))


def bracketed(x: np.ndarray, y: np.ndarray, n: np.ndarray, few: int) -> float | None:
    """The middle slope of one group without all its pairs: the wanted ranks are bracketed by counts at
    trial slopes until `few` slopes are left, which are listed."""
    order = np.lexsort([y, x])
    x, y, n = x[order], y[order], n[order]
    level = np.add.reduceat(n, np.unique(x, return_index=True)[1]).tolist()
    total = (sum(level) ** 2 - sum(w * w for w in level)) // 2
    if not total:
        return None
    picked = np.random.default_rng(0).permutation(len(x))[:SAMPLE]
    slopes, weights = sample_slopes(x[picked], y[picked], n[picked])
    values = []
    low, high, below, upto = -WIDEST, WIDEST, 0, total
    for rank in sorted({(total + 1) // 2, total // 2 + 1}):
        if not below < rank <= upto:
            low, high, below, upto = -WIDEST, WIDEST, 0, total
        while not (narrow := high - low <= max(abs(low), abs(high)) * 1e-15 + 1e-13):
            if upto - below <= few and high - low < WIDEST / 2:
                break
            inside = (slopes > low) & (slopes < high)
            part = (rank - below) / (upto - below)
            open_ = trials(low, high, part, slopes[inside], weights[inside]).tolist()
            if not open_:
                narrow = True
                break
            while open_:
                at = len(open_) // 2
                count = inversion_weight(ranks_of(y - open_[at] * x), n)
                if count < rank:
                    low, below, open_ = open_[at], count, open_[at + 1 :]
                else:
                    high, upto, open_ = open_[at], count, open_[:at]
        listed, times = crossing(x, y, n, low, high, None) if not narrow else (np.zeros(0), None)
        values.append(nth(listed, times, rank - below) if len(listed) else (low + high) / 2)
    return sum(values) / len(values)


def nth(slopes: np.ndarray, weights: np.ndarray, rank: int) -> float:
    """The slope of a rank (from 1) among listed ones."""
    order = np.argsort(slopes, kind="stable")
    at = int(np.searchsorted(np.cumsum(weights[order]), rank))
    return float(slopes[order[min(at, len(order) - 1)]])


def solved(groups: DataFrame, keys: list[str], whole: int, few: int) -> DataFrame:
    """(keys, slope, intercept, n_laps) of groups that are one row (keys, n_laps, p: list of points).
    Groups whose points have one x have no row."""
    schema = StructType(
        [
            *[groups.schema[k] for k in keys],
            StructField("slope", DoubleType()),
            StructField("intercept", DoubleType()),
            StructField("n_laps", LongType()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, y, n), ends = points_of(batch.column("p"))
            at, fits, start = [], [], 0
            for i, end in enumerate(ends.tolist()):
                fit = fitted(x[start:end], y[start:end], n[start:end], whole, few)
                start = end
                if fit is not None:
                    at.append(i)
                    fits.append(fit)
            if fits:
                slope, intercept = zip(*fits, strict=True)
                held = batch.take(pa.array(at, pa.int64()))
                yield pa.record_batch(
                    {
                        **{k: held.column(k) for k in keys},
                        "slope": pa.array(slope, pa.float64()),
                        "intercept": pa.array(intercept, pa.float64()),
                        "n_laps": held.column("n_laps"),
                    }
                )

    return groups.select(*keys, "n_laps", "p").mapInArrow(run, schema)


def trials(low: float, high: float, part: float, slopes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Trial slopes between two ends: of the sample's slopes there those about the wanted part, others
    evenly spaced, and on a very wide stretch a few of each size. None is a round number, so that a
    slope which many pairs share is not met itself."""
    near = far = np.zeros(0)
    if len(slopes):
        order = np.argsort(slopes, kind="stable")
        upto = np.cumsum(weights[order]) / weights.sum()
        about = part + np.array([-0.3, -0.1, -0.03, -0.01, 0.01, 0.03, 0.1, 0.3])
        near = slopes[order[np.searchsorted(upto, np.clip(about, 0, upto[-1]))]]
        near = near + np.spacing(np.abs(near)) * 1e4 * np.sqrt(2) * np.where(about < part, -1, 1)
    if high - low > 1e3:
        far = np.sqrt(2) * np.array([-1e9, -1e3, -1, 1, 1e3, 1e9])
    known = np.concatenate([near, far])
    known = known[(known > low) & (known < high)]
    steps = TRIALS - len(known)
    even = low + (high - low) * (np.arange(1, steps + 1) - 0.0141421356) / (steps + 1)
    found = np.unique(np.concatenate([known, even]))
    return found[(found > low) & (found < high)]


def splitters(x: np.ndarray, y: np.ndarray, slope: float, cells: int) -> np.ndarray:
    """Ends of cells of y - slope * x, all but the last, from a sample of points."""
    z = np.sort(y - slope * x)
    return z[np.arange(1, cells) * len(z) // cells]


def asked(state: DataFrame) -> DataFrame:
    """(g, slope, cuts): a row for every trial slope of the open brackets `state`, those of a group's two
    middle ranks together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, y, n), ends = points_of(batch.column("sample"))
            rows, start = [], 0
            for i, end in enumerate(ends.tolist()):
                g, low, high, part, cells = (batch.column(k)[i].as_py() for k in range(5))
                px, py, pn = x[start:end], y[start:end], n[start:end]
                start = end
                for slope in trials(low, high, part, *sample_slopes(px, py, pn)):
                    rows.append((g, float(slope), splitters(px, py, slope, cells)))
            if rows:
                g, slope, cuts = zip(*rows, strict=True)
                yield pa.record_batch(
                    {
                        "g": pa.array(g, pa.int64()),
                        "slope": slope,
                        "cuts": pa.array(cuts, pa.list_(pa.float64())),
                    }
                )

    rows = state.select("g", "low", "high", "part", "cells", "sample")
    found = rows.mapInArrow(run, "g bigint, slope double, cuts array<double>")
    return found.dropDuplicates(["g", "slope"])


def counts_in_blocks(rows: DataFrame) -> DataFrame:
    """For each block and trial slope: its inversions, the weight of its points in every cell, and the
    cells' points themselves, sorted, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, y, n), ends = points_of(batch.column("p"))
            start = 0
            for i, end in enumerate(ends.tolist()):
                slope = batch.column("slope")[i].as_py()
                cuts = batch.column("cuts")[i].values.to_numpy()
                z, w = y[start:end] - slope * x[start:end], n[start:end]
                start = end
                own = inversion_weight(ranks_of(z), w)
                order = np.argsort(z, kind="stable")
                z, w = z[order], w[order]
                at = [0, *np.searchsorted(z, cuts, side="right").tolist(), len(z)]
                upto = np.concatenate([[0], np.cumsum(w)])
                spans = list(zip(at, at[1:]))
                yield pa.record_batch(
                    {
                        **{k: batch.column(k).slice(i, 1) for k in ("g", "slope", "block")},
                        "own": pa.array([own], pa.int64()),
                        "weights": pa.array([np.diff(upto[at])], pa.list_(pa.int64())),
                        "pieces": pa.array(
                            [[z[a:b].tobytes() + w[a:b].tobytes() for a, b in spans]], pa.list_(pa.binary())
                        ),
                    }
                )

    schema = "g bigint, slope double, block int, own bigint, weights array<bigint>, pieces array<binary>"
    return rows.select("g", "slope", "block", "cuts", "p").mapInArrow(run, schema)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.frombuffer(raw[:half], np.float64), np.frombuffer(raw[half:], np.int64)


@F.udf(LongType())
def across_pieces(pieces):
    """Inversions between the pieces of a cell (block, bytes), in the order of their blocks."""
    parts = [unpacked(bytes(raw)) for _, raw in sorted(pieces)]
    z = np.concatenate([p[0] for p in parts])
    return inversion_weight(ranks_of(z), np.concatenate([p[1] for p in parts]))


@F.udf(LongType())
def across_cells(rows):
    """Inversions between points of different blocks and cells, from (block, weights of cells)."""
    grid = np.array([w for _, w in sorted(rows)], dtype=np.int64)
    earlier = np.cumsum(grid, axis=0) - grid  # in blocks before, by cell
    later = earlier[:, ::-1].cumsum(axis=1)[:, ::-1] - earlier  # and in cells behind
    return int((grid * later).sum())


def slopes_below(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, slope, below): the number of a group's slopes below each wanted slope."""
    rows = work_table(counts_in_blocks(blocks.join(wanted, "g")), "counts")
    keys = ["g", "slope"]
    own = rows.groupBy(*keys).agg(
        F.sum("own").alias("below"), F.collect_list(F.struct("block", "weights")).alias("rows")
    )  # at most MOST_BLOCKS rows of as many cells
    cells = (
        rows.select(*keys, "block", F.posexplode("pieces").alias("cell", "piece"))
        .where(F.length("piece") > 0)
        .groupBy(*keys, "cell")
        .agg(F.collect_list(F.struct("block", "piece")).alias("pieces"))
    )
    met = cells.select(*keys, across_pieces("pieces").alias("below"))
    whole = own.select(*keys, (F.col("below") + across_cells("rows")).alias("below"))
    return whole.unionByName(met).groupBy(*keys).agg(F.sum("below").alias("below"))


def narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The brackets with the nearest trial slopes for ends: the wanted slope is not below the lower end and
    below the upper one."""
    under = F.col("count") < F.col("rank")
    trial = F.struct("slope", "count")
    new = (
        state.select("g", "target", "rank")
        .join(counts.withColumnRenamed("below", "count"), "g")
        .groupBy("g", "target")
        .agg(F.max(F.when(under, trial)).alias("up"), F.min(F.when(~under, trial)).alias("down"))
    )
    ends = ("low", "high", "below", "upto")
    return (
        state.join(new, ["g", "target"])
        .withColumn("up", F.greatest("up", F.struct(F.col("low").alias("slope"), F.col("below").alias("count"))))
        .withColumn("down", F.least("down", F.struct(F.col("high").alias("slope"), F.col("upto").alias("count"))))
        .select(
            *[c for c in state.columns if c not in ends],
            F.col("up.slope").alias("low"),
            F.col("down.slope").alias("high"),
            F.col("up.count").alias("below"),
            F.col("down.count").alias("upto"),
        )
    )


def cell_points(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(g, target, low, high, cell, p): the points of each bracket's group by cells of their order at the
    lower end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, y, n), ends = points_of(batch.column("p"))
            (sx, sy, _), sample_ends = points_of(batch.column("sample"))
            start = s_start = 0
            for i, (end, s_end) in enumerate(zip(ends.tolist(), sample_ends.tolist(), strict=True)):
                low, cells = batch.column("low")[i].as_py(), batch.column("cells")[i].as_py()
                cuts = splitters(sx[s_start:s_end], sy[s_start:s_end], low, cells)
                px, py, pn = x[start:end], y[start:end], n[start:end]
                start, s_start = end, s_end
                cell = np.searchsorted(cuts, py - low * px, side="left")
                order = np.argsort(cell, kind="stable")
                found, at = np.unique(cell[order], return_index=True)
                spans = list(zip(at.tolist(), [*at[1:].tolist(), len(order)]))
                stack = np.stack([px, py, pn.astype(np.float64)])[:, order]
                yield pa.record_batch(
                    {
                        **{
                            k: pa.array([batch.column(k)[i].as_py()] * len(found), batch.column(k).type)
                            for k in ("g", "target", "low", "high")
                        },
                        "cell": pa.array(found, pa.int32()),
                        "piece": pa.array([stack[:, a:b].tobytes() for a, b in spans], pa.binary()),
                    }
                )

    wanted = state.select("g", "target", "low", "high", "cells", "sample")
    rows = blocks.join(wanted, "g").select("g", "target", "low", "high", "cells", "sample", "p")
    pieces = rows.mapInArrow(
        run, "g bigint, target bigint, low double, high double, cell int, piece binary"
    )
    return pieces.groupBy("g", "target", "low", "high", "cell").agg(F.collect_list("piece").alias("pieces"))


def crossing(x: np.ndarray, y: np.ndarray, n: np.ndarray, low: float, high: float, other: np.ndarray | None):
    """(slopes, weights) of the pairs whose order at the two ends differs; with `other`, a number for
    each point, only of pairs of different numbers."""
    at_low, at_high = y - low * x, y - high * x
    order = np.lexsort([x, at_low])  # pairs that are level at the lower end have its slope: they differ
    i, j = inversion_pairs(ranks_of(at_high)[order])
    i, j = order[i], order[j]
    if other is not None:
        apart = other[i] != other[j]
        i, j = i[apart], j[apart]
    dx = x[j] - x[i]
    real = dx != 0
    return (y[j] - y[i])[real] / dx[real], (n[i] * n[j])[real].astype(np.int64)


def stacked(pieces: list) -> np.ndarray:
    return np.concatenate([np.frombuffer(bytes(p), np.float64).reshape(3, -1) for p in pieces], axis=1)


SLOPES = [StructField("slopes", BinaryType()), StructField("weights", BinaryType())]
ENDS = [StructField("low", DoubleType()), StructField("high", DoubleType())]


@F.udf(StructType([*ENDS, *SLOPES]))
def listed_in_cell(pieces, low, high):
    """The least and greatest y - high * x of a cell, and the slopes between its points."""
    x, y, n = stacked(pieces)
    slopes, weights = crossing(x, y, n, low, high, None)
    at = y - high * x
    return float(at.min()), float(at.max()), slopes.tobytes(), weights.tobytes()


@F.udf(BinaryType())
def reaching(pieces, high, least, most):
    """The points of a cell that some point of another cell passes on the way to the upper end: below the
    greatest of the cells before or above the least of those behind."""
    points = stacked(pieces)
    at = points[1] - high * points[0]
    out = np.zeros(len(at), bool)
    if most is not None:
        out |= at < most
    if least is not None:
        out |= at > least
    return points[:, out].tobytes()


@F.udf(StructType(SLOPES))
def listed_across(rows, low, high):
    """The slopes between points of different cells, from (cell, points that reach out)."""
    points = stacked([r[1] for r in rows])
    cell = np.concatenate([np.full(len(r[1]) // 24, r[0]) for r in rows])
    slopes, weights = crossing(*points, low, high, cell)
    return slopes.tobytes(), weights.tobytes()


@F.udf(DoubleType())
def ranked(rows, rank):
    """The slope of a rank (from 1) among listed ones."""
    if rows is None:
        return None
    slopes = np.concatenate([np.frombuffer(bytes(r[0]), np.float64) for r in rows])
    weights = np.concatenate([np.frombuffer(bytes(r[1]), np.int64) for r in rows])
    return nth(slopes, weights, rank)


def located(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(g, target, value): the wanted slope of brackets with few slopes, all of which are listed."""
    keys = ["g", "target", "low", "high"]
    cells = work_table(
        cell_points(blocks, state).withColumn("own", listed_in_cell("pieces", "low", "high")), "cells"
    )
    ends = cells.select(*keys, "cell", F.col("own.low").alias("least"), F.col("own.high").alias("most"))
    # at most MOST_BLOCKS cells a bracket; the ends of those before and behind are carried along
    before = F.array_max(F.transform(F.filter("ends", lambda e: e["cell"] < F.col("cell")), lambda e: e["most"]))
    behind = F.array_min(F.transform(F.filter("ends", lambda e: e["cell"] > F.col("cell")), lambda e: e["least"]))
    carried = (
        ends.groupBy(*keys)
        .agg(F.collect_list(F.struct("cell", "least", "most")).alias("ends"))
        .select(*keys, "ends", F.explode("ends.cell").alias("cell"))
        .select("g", "target", "cell", before.alias("most"), behind.alias("least"))
    )
    out = (
        cells.join(carried, ["g", "target", "cell"])
        .select(*keys, "cell", reaching("pieces", "high", "least", "most").alias("points"))
        .where(F.length("points") > 0)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("cell", "points")).alias("rows"))  # each is in a listed slope
        .select("g", "target", listed_across("rows", "low", "high").alias("own"))
    )
    found = (
        cells.select("g", "target", "own.slopes", "own.weights")
        .unionByName(out.select("g", "target", "own.slopes", "own.weights"))
        .where(F.length("slopes") > 0)
        .groupBy("g", "target")
        .agg(F.collect_list(F.struct("slopes", "weights")).alias("rows"))
    )
    middle = (F.col("low") + F.col("high")) / 2  # where rounding leaves nothing between two close ends
    value = F.when(F.col("rows").isNotNull(), ranked("rows", F.col("rank") - F.col("below")))
    return state.join(found, ["g", "target"], "left").select(
        "g", "target", F.coalesce(value, middle).alias("value")
    )


def large_slopes(counted: DataFrame, sizes: DataFrame, block: int, few: int) -> DataFrame:
    """(g, slope) of groups of any size. `counted` has (g, x, y, n), `sizes` (g, points, _n)."""
    points = sizes.agg(F.sum("points")).first()[0] or 0
    if not points:
        return sizes.sparkSession.createDataFrame([], "g long, slope double")
    largest = sizes.agg(F.max("points")).first()[0]
    held = max(block, -(-largest // MOST_BLOCKS))
    ranged = counted.repartitionByRange(-(-points // held) + 1, "g", "x", "y").withColumn(
        "block", F.spark_partition_id()
    )
    blocks = work_table(
        work_table(ranged, "points")
        .groupBy("g", "block")
        .agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("p")),
        "blocks",
    )
    by_x = counted.groupBy("g", "x").agg(F.sum("n").alias("n"))
    wide = F.col("n").cast("decimal(20,0)")
    total = by_x.groupBy("g").agg(((F.sum(wide) * F.sum(wide) - F.sum(wide * wide)) / 2).cast("bigint").alias("total"))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("points"))
    picked = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < share * (1 << 30)
    sample = (
        counted.join(sizes.select("g", "points"), "g")
        .where(picked)
        .groupBy("g")
        .agg(F.collect_list(F.struct("x", "y", "n")).alias("sample"))
    )
    cells = blocks.groupBy("g").agg(F.count("*").cast("int").alias("cells"))
    ranks = F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")))
    state = work_table(
        total.where("total > 0")
        .join(sample, "g")
        .join(cells, "g")
        .withColumn("rank", F.explode(ranks))
        .select(
            "g",
            F.col("rank").alias("target"),
            "rank",
            (F.col("rank") / F.col("total")).alias("part"),
            "cells",
            "sample",
            F.lit(-WIDEST).alias("low"),
            F.lit(WIDEST).alias("high"),
            F.lit(0).cast("bigint").alias("below"),
            F.col("total").alias("upto"),
        ),
        "brackets",
    )
    apart = F.greatest(F.abs("low"), F.abs("high")) * 1e-15 + 1e-13
    narrow = F.col("high") - F.col("low") <= apart
    listable = (F.col("upto") - F.col("below") <= few) & (F.col("high") - F.col("low") < WIDEST / 2)
    done = narrow | listable
    while not (left := state.where(~done)).isEmpty():
        counts = slopes_below(blocks, asked(left))
        state = work_table(state.where(done).unionByName(narrowed(left, counts)), "brackets")
    values = located(blocks, state.where(~narrow)).unionByName(
        state.where(narrow).select("g", "target", ((F.col("low") + F.col("high")) / 2).alias("value"))
    )
    return values.groupBy("g").agg(F.avg("value").alias("slope"))


def theil_sen(
    points: DataFrame,
    keys: list[str],
    min_points: int,
    whole: int = WHOLE,
    block: int = BLOCK,
    few: int = FEW,
    held: int = HELD,
) -> DataFrame:
    """Median of the slopes between all points of distinct `x`, and the median of y - slope * x, for
    groups of at least `min_points`: keys, slope, intercept, n_laps. A null key is a group like any other;
    points without x or y are passed over. In a group beyond `whole` points where more than `few` pairs
    share the middle slope, it is told to thirteen decimals; all other results are the middle of the
    slopes as they are.

    Groups fall in buckets by their keys. Those of buckets of up to `held` rows are dealt by their keys,
    once; any others, which may hold any share of the rows, go over blocks."""
    known = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "x", "y")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = work_table(
        known.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > held), "full"
    )
    if full.isEmpty():
        return dealt_fits(known, keys, min_points, whole, few)
    marked, named = known.withColumn("_bucket", bucket), F.broadcast(full.select("_bucket"))
    short = marked.join(named, "_bucket", "left_anti").drop("_bucket")
    long = marked.join(named, "_bucket", "left_semi").drop("_bucket")
    return dealt_fits(short, keys, min_points, whole, few).unionByName(
        spread_fits(long, keys, min_points, whole, block, few)
    )


def dealt_fits(points: DataFrame, keys: list[str], min_points: int, whole: int, few: int) -> DataFrame:
    """Fits of groups that one task may hold: one shuffle, by the keys."""
    groups = (
        points.repartition(*keys)
        .groupBy(*keys, "x", "y")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n_laps"), F.collect_list(F.struct("x", "y", "n")).alias("p"))
        .where(F.col("n_laps") >= min_points)
    )
    return solved(groups, keys, whole, few)


def spread_fits(
    points: DataFrame, keys: list[str], min_points: int, whole: int, block: int, few: int
) -> DataFrame:
    """Fits of groups of any size. Equal points are counted before the shuffle."""
    counted = work_table(points.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")), "points")
    sizes = work_table(
        counted.groupBy(*keys)
        .agg(F.sum("n").alias("n_laps"), F.count("*").alias("points"))
        .where(F.col("n_laps") >= min_points)
        .withColumn("_g", F.monotonically_increasing_id()),
        "sizes",
    )
    numbered = joined(counted, sizes.select(*keys, "_g", "points"), keys).select(
        F.col("_g").alias("g"), "x", "y", "n", "points"
    )
    small = (
        numbered.where(F.col("points") <= whole)
        .groupBy("g")
        .agg(F.sum("n").alias("n_laps"), F.collect_list(F.struct("x", "y", "n")).alias("p"))
    )
    fits = solved(small, ["g"], whole, few).drop("n_laps")
    large = sizes.where(F.col("points") > whole).select(F.col("_g").alias("g"), "points")
    if not large.isEmpty():
        rows = work_table(numbered.where(F.col("points") > whole).select("g", "x", "y", "n"), "large")
        steep = work_table(large_slopes(rows, large, block, few), "slopes")
        residual = rows.join(steep, "g").select("g", (F.col("y") - F.col("slope") * F.col("x")).alias("r"), "n")
        level = exact_quantiles(residual, ["g"], "r", {"intercept": 0.5}, weight="n")
        fits = fits.unionByName(steep.join(level, "g").select("g", "slope", "intercept"))
    return sizes.join(fits.withColumnRenamed("g", "_g"), "_g").select(*keys, "slope", "intercept", "n_laps")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join on keys that may be null, without columns of the right side beside the keys that
    the left has too."""
    extra = [c for c in right.columns if c not in keys and c not in left.columns]
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])
