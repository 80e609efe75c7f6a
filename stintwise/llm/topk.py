"""Exact top-k search by inner product through distributed histogram selection.

Candidates are packed in blocks where they lie and stay there. Queries come in groups of bounded size
(`GROUP_BYTES`), which are sent to the executors one after another. For a group every score is worked
out, and global histograms of the scores locate each query's k-th highest value: a round counts 256 bins
between two bounds, the bin that holds the k-th value becomes the next round's bounds, until a bin is
one value wide. A last pass keeps what lies above, and of the ties the smallest ids. Scores are worked
out anew in every pass; none are stored. Shuffled are histograms and kept scores, never vectors.
"""

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.batches import give_back
from stintwise.session import work_table

K = 20
BINS = 256
GROUP_BYTES = 16 << 20  # of the queries that are sent together
CANDIDATES = 4096  # rows of a block
STEP = 512  # queries that a task scores at a time
SCALE = 64.0
WIDEST = 1 << 62  # scores beyond are an error: they, or differences of them, would leave 64 bits
TYPES = (np.int16, np.int32, np.int64)


def integers(vector: Column) -> Column:
    """floor(64 * x) of every component, x as double. The result stays a double: where it does not fit 53
    bits it is 64 * x itself, so no value is lost at any size."""

    def one(x: Column) -> Column:
        big = x.cast("double") * F.lit(SCALE)
        return F.when(F.abs(big) < F.lit(2.0**52), F.floor(big).cast("double")).otherwise(big)

    return F.transform(vector, one)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector)
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < limit))
    return rows.where(F.col(id_column).isNotNull() & v.isNotNull() & fine).select(
        F.col(id_column).cast("bigint").alias("vec_id"), integers(v).alias("v")
    )


def narrowed(values: np.ndarray) -> np.ndarray:
    """Whole doubles as the narrowest whole numbers that hold them, or as they are."""
    most = np.abs(values).max(initial=0.0)
    for kind in TYPES:
        if most < float(np.iinfo(kind).max):
            return values.astype(kind)
    return values


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of a column of lists by the lists' length: (rows, matrix)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = (at, flat[offsets[at][:, None] + np.arange(size)])
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """(dim, kind, ids, matrix): candidates of one length, packed without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        counts: dict[int, int] = {}

        def packed(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            counts.pop(dim)
            matrix = narrowed(np.concatenate([m for _, m in parts]))
            ids = np.concatenate([i for i, _ in parts])
            return pa.record_batch(
                {
                    "dim": pa.array([dim], pa.int32()),
                    "kind": [matrix.dtype.str],
                    "ids": [ids.tobytes()],
                    "matrix": [matrix.tobytes()],
                }
            )

        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(start, CANDIDATES)
                ids = part.column("vec_id").to_numpy()
                for dim, (at, matrix) in by_length(part.column("v")).items():
                    held.setdefault(dim, []).append((ids[at], matrix))
                    counts[dim] = counts.get(dim, 0) + len(at)
                    if counts[dim] >= CANDIDATES:
                        yield packed(dim)
        for dim in list(held):
            yield packed(dim)
        give_back()

    return rows.mapInArrow(run, "dim int, kind string, ids binary, matrix binary")


def scores(q: np.ndarray, c: np.ndarray, real: np.ndarray) -> np.ndarray:
    """All inner products, exact at any size of the components: in doubles where no sum can pass 2**53,
    in 64-bit integers below 2**61, else in integers of any size. A score beyond 2**62 of a pair that
    is `real` is an error; others count for nothing."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**61:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], dtype=object) for m in (q, c)]
    found = np.where(real, whole[0] @ whole[1].T, 0)
    if max(abs(s) for s in found.ravel()) >= WIDEST:
        raise OverflowError("a score leaves 64 bits")
    return found.astype(np.int64)


class Queries(NamedTuple):
    """A group of queries of one length, with the bounds of the bins that are looked at and the number of
    scores still needed inside them. `first` is the group's number of the first of them."""

    first: int
    ids: np.ndarray
    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray
    width: int
    need: np.ndarray


def scored(batches: Iterable[pa.RecordBatch], group: dict[int, Queries]):
    """(queries' numbers, their bounds, candidates' ids, scores, takes part) of each part of the group
    with each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            mine = group.get(batch.column("dim")[i].as_py())
            if mine is None:
                continue
            ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
            kind = np.dtype(batch.column("kind")[i].as_py())
            matrix = np.frombuffer(batch.column("matrix")[i].as_py(), kind).reshape(len(ids), -1)
            for start in range(0, len(mine.ids), STEP):
                part = slice(start, start + STEP)
                real = mine.ids[part][:, None] != ids[None, :]
                s = scores(mine.matrix[part], matrix, real)
                cut = mine._replace(
                    first=mine.first + start,
                    ids=mine.ids[part],
                    low=mine.low[part][:, None],
                    high=mine.high[part][:, None],
                    need=mine.need[part][:, None],
                )
                yield cut, ids, s, real


def histograms(candidates: DataFrame, group: dict[int, Queries], k: int) -> DataFrame:
    """(at, bin, n): counts of the scores inside the bounds by query and bin. A block sends a query's
    highest bins only, down to the one with its own k-th score: the k-th of all is not below."""
    shared = candidates.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, _, s, real in scored(batches, shared.value):
            real &= (s >= mine.low) & (s < mine.high)
            bin_ = (s - mine.low) // mine.width
            at = np.broadcast_to(np.arange(len(s))[:, None], s.shape)[real]
            count = np.bincount(at * BINS + bin_[real], minlength=len(s) * BINS).reshape(-1, BINS)
            above = count[:, ::-1].cumsum(axis=1)[:, ::-1] - count
            at, bin_ = np.nonzero((count > 0) & (above < k))
            yield pa.record_batch(
                {
                    "at": pa.array(at + mine.first, pa.int32()),
                    "bin": pa.array(bin_, pa.int32()),
                    "n": pa.array(count[at, bin_], pa.int64()),
                }
            )
        give_back()

    found = candidates.mapInArrow(run, "at int, bin int, n bigint")
    return found.groupBy("at", "bin").agg(F.sum("n").alias("n"))


def reached(counts: DataFrame, need: np.ndarray) -> np.ndarray:
    """For each query of the group the bin of its k-th value, -1 if it has fewer scores, and the number of
    scores above that bin. A query has 256 bins at most, and one row that comes back."""
    runs = counts.groupBy("at").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, bins in zip(batch.column("at").to_pylist(), batch.column("bins").to_pylist(), strict=True):
                above = 0
                for one in bins:
                    if above + one["n"] >= need[at]:
                        out.append((at, one["bin"], above))
                        break
                    above += one["n"]
            if out:
                columns = zip(*out, strict=True)
                yield pa.record_batch({k: pa.array(c, pa.int64()) for k, c in zip(("at", "bin", "above"), columns)})

    found = runs.mapInArrow(run, "at bigint, bin bigint, above bigint").toArrow()
    out = np.full((len(need), 2), -1, np.int64)
    out[found.column("at").to_numpy()] = np.stack(
        [found.column("bin").to_numpy(), found.column("above").to_numpy()], axis=1
    )
    return out


def refined(group: dict[int, Queries], found: np.ndarray) -> dict[int, Queries]:
    """Bounds one round narrower. A query with fewer than `need` candidates takes all there are: its
    bounds move below every score."""
    out = {}
    for dim, q in group.items():
        bin_, above = found[q.first : q.first + len(q.ids)].T
        some = bin_ >= 0
        low = np.where(some, q.low + bin_ * q.width, q.low - 1)
        out[dim] = q._replace(
            low=low,
            high=np.where(some, low + q.width, low + 1),
            width=max(1, -(-q.width // BINS)),
            need=np.where(some, q.need - above, q.need),
        )
    return out


def kept(candidates: DataFrame, group: dict[int, Queries]) -> DataFrame:
    """(query_id, vec_id, score): scores above the located value, and the smallest ids at it, as many
    as are needed."""
    shared = candidates.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, ids, s, real in scored(batches, shared.value):
            order = np.argsort(ids, kind="stable")
            ties = (real & (s == mine.low))[:, order]
            take = real & (s > mine.low)
            take[:, order] |= ties & (ties.cumsum(axis=1) <= mine.need)
            i, j = np.nonzero(take)
            yield pa.record_batch({"query_id": mine.ids[i], "vec_id": ids[j], "score": s[i, j]})
        give_back()

    return candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def group_of(rows: pa.Table, k: int, reach: int) -> dict[int, Queries]:
    """The queries of a group by length, with bounds that hold every score."""
    width = max(1, -(-(2 * reach + 1) // BINS))
    out, first = {}, 0
    ids = rows.column("vec_id").to_numpy()
    for dim, (at, matrix) in by_length(rows.column("v").combine_chunks()).items():
        n = len(at)
        low = np.full(n, -reach, np.int64)
        high = np.full(n, min(width * BINS - reach, 2**63 - 1), np.int64)
        out[dim] = Queries(first, ids[at], narrowed(matrix), low, high, width, np.full(n, k, np.int64))
        first += n
    return out


def top_k(
    rows: DataFrame,
    k: int = K,
    every: int = 20,
    id_column: str = "vec_id",
    vector: str = "embedding",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` the `k` highest
    inner products with all other rows, ties to the smaller vec_id; all, if there are fewer.

    Components count as floor(64 * x), exactly at any size; a score beyond 2**62 raises an error. Vectors
    that are null or hold null or non-finite components (64 times a component included) take no part, nor
    do rows without an id; vectors meet those of their own length. Of query rows that share an id the
    first by vector counts, as candidates all do; a query never meets its own id. Other columns are not
    read. An empty table gives an empty result."""
    real = usable(rows, id_column, vector)
    candidates = work_table(blocks(real), "candidates")
    one_each = (
        real.where(F.pmod("vec_id", F.lit(every)) == 0)
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )
    queries = work_table(one_each, "queries")
    largest = F.array_max(F.transform("v", F.abs))
    most, dim = real.agg(F.max(largest), F.max(F.size("v"))).first()
    size = queries.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    reach = WIDEST if (most or 0.0) ** 2 * (dim or 0) >= WIDEST / 2 else int((most or 0.0) ** 2 * (dim or 0)) + 1
    groups = max(1, -(-size * 8 // group_bytes))
    parts = []
    for number in range(groups):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == number).toArrow()
        if not mine.num_rows:
            continue
        group = group_of(mine, k, reach)
        need = lambda: np.concatenate([q.need for q in group.values()])
        while True:
            last = next(iter(group.values())).width == 1
            group = refined(group, reached(histograms(candidates, group, k), need()))
            if last:
                break
        parts.append(work_table(kept(candidates, group), "found"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
