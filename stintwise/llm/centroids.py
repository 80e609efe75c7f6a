"""k-means over whole-number vectors with a VA-file: few-bit cells bound every distance.

Each component of a vector is also kept as the number of its cell, four bits. A lookup table of a round
holds, for a pair of components and each pair of cells, the least and the greatest squared distance to
every centroid; 32 lookups and additions per vector give an interval for each centroid. A centroid
whose interval starts above the end of another's cannot be the nearest. Where one centroid is left, the
cells decide; full vectors are fetched, and exact distances worked out, only where intervals overlap,
and only to the centroids that do. Cells change the work, never the result.

Cell borders come from a bounded sample (`SAMPLE` rows); the outermost cells end at the least and
greatest component of the whole table. Every vector is indexed. New centroids are exact sums in
whole numbers: partial sums of a task meet in a grouped sum of one row per centroid and component, so
a centroid with most of the vectors is no hot key. They need each vector once a round, in the same scan
of the stored table that reads the cells; what the intervals save are distances, not bytes.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.session import work_table

DIMENSIONS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
BITS = 4
CELLS = 1 << BITS
SAMPLE = 4096
"""Vectors that the cell borders are taken from, those with the smallest hashes of their ids."""
STEP = 4096
"""Vectors a task works on at a time."""
SMALL = 1 << 27
"""Below this size of components squared distances of 64 components fit 64 bits."""
WIDEST = 1 << 62


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector): the vectors with exactly 64 components, none null or not finite, as
    floor(256 * component). A component beyond 2**62 after that is an error: 64-bit distances could
    not hold it."""
    parts = F.col("embedding").cast("array<double>")

    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def cell(x: Column) -> Column:
        wide = F.abs(x * SCALE) >= F.lit(float(WIDEST))
        return F.when(wide, F.raise_error(F.lit("a component is too large"))).otherwise(
            F.floor(x * SCALE)
        )

    whole = (F.size(parts) == DIMENSIONS) & F.forall(parts, fine)
    return table.where(F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(parts, cell).alias("vector")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A column of 64-component lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def borders(vectors: DataFrame) -> np.ndarray:
    """The lower borders of cells 1 to 15 of each component: a row a component."""
    order = [F.xxhash64("vec_id"), F.col("vector")]
    sample = [r[0] for r in vectors.orderBy(*order).limit(SAMPLE).select("vector").collect()]
    ranks = [i * len(sample) // CELLS for i in range(1, CELLS)]
    return np.sort(np.array(sample, dtype=np.int64), axis=0)[ranks].T


def indexed(vectors: DataFrame, inner: np.ndarray) -> DataFrame:
    """The vectors with their cells, two to a byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("vector"))
            cells = np.empty(rows.shape, dtype=np.uint8)
            for d in range(DIMENSIONS):
                cells[:, d] = np.searchsorted(inner[d], rows[:, d], side="right")
            pairs = cells[:, ::2] | cells[:, 1::2] << BITS
            yield batch.append_column("cells", pa.array([r.tobytes() for r in pairs], pa.binary()))

    return vectors.mapInArrow(run, "vec_id bigint, vector array<bigint>, cells binary")


def ends(index: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each component, over all vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("vector"))
                low = rows.min(axis=0) if low is None else np.minimum(low, rows.min(axis=0))
                high = rows.max(axis=0) if high is None else np.maximum(high, rows.max(axis=0))
        if low is not None:
            yield pa.record_batch({"d": np.arange(DIMENSIONS), "low": low, "high": high})

    parts = index.select("vector").mapInArrow(run, "d bigint, low bigint, high bigint")
    rows = parts.groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").collect()
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact at any size: 64-bit numbers where those hold them."""
    if max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))) >= SMALL:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(axis=-1)


def interval_tables(
    centroids: np.ndarray, inner: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance, by pair of components, byte of two cells and centroid. The
    differences are exact; a slack covers the rounding of their squares and sums as doubles."""
    first = np.concatenate([np.minimum(low[:, None], inner[:, :1]), inner], axis=1)
    last = np.concatenate([inner - 1, np.maximum(high[:, None], inner[:, -1:])], axis=1)
    first, last, at = (x.astype(object) for x in (first, last, centroids.T))
    above = first[:, :, None] - at[:, None, :]  # component, cell, centroid
    below = at[:, None, :] - last[:, :, None]
    least = np.maximum(np.maximum(above, below), 0)
    most = np.maximum(np.abs(above), np.abs(below))

    def by_pair(x: np.ndarray) -> np.ndarray:
        x = (x * x).astype(np.float64)
        pair = x[1::2, :, None, :] + x[::2, None, :, :]  # the second component's cell is the high half
        return pair.reshape(DIMENSIONS // 2, CELLS * CELLS, -1)

    return by_pair(least) * (1 - 1e-9), by_pair(most) * (1 + 1e-9)


class Assigner:
    """Nearest centroids of batches of indexed vectors."""

    def __init__(self, centroids: np.ndarray, inner: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.centroids = centroids
        self.least, self.most = interval_tables(centroids, inner, low, high)
        self.fetched = 0

    def nearest(self, cells: np.ndarray, vectors: pa.Array) -> np.ndarray:
        """The nearest centroid of each row of `cells`, of equally near ones the smallest. Rows of
        `vectors` are read only where intervals overlap."""
        start, end = np.zeros((2, len(cells), len(self.centroids)))
        for pair in range(cells.shape[1]):
            start += self.least[pair][cells[:, pair]]
            end += self.most[pair][cells[:, pair]]
        left = start <= end.min(axis=1, keepdims=True)
        out = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            self.fetched += len(open_rows)
            full = matrix(vectors.take(pa.array(open_rows)))
            row, centroid = np.nonzero(left[open_rows])
            far = squares(full[row], self.centroids[centroid])
            firsts = np.searchsorted(row, np.arange(len(open_rows)))
            best = np.minimum.reduceat(far, firsts)
            met = np.flatnonzero(far == best[row])
            out[open_rows] = centroid[met[np.searchsorted(row[met], np.arange(len(open_rows)))]]
        return out


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def cell_rows(batch: pa.RecordBatch) -> np.ndarray:
    raw = b"".join(batch.column("cells").to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(batch.num_rows, -1)


def moved(index: DataFrame, centroids: np.ndarray, *cut: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then each centroid that has vectors to the
    floor of their mean."""
    count = len(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, *cut)
        sums, sizes = np.zeros((count, DIMENSIONS), dtype=object), np.zeros(count, dtype=np.int64)
        for batch in slices(batches):
            to = assigner.nearest(cell_rows(batch), batch.column("vector"))
            rows = matrix(batch.column("vector"))
            if int(np.abs(rows).max()) >= SMALL:
                rows = rows.astype(object)
            sizes += np.bincount(to, minlength=count)
            for c in np.unique(to):
                sums[c] += rows[to == c].sum(axis=0)
        full = np.flatnonzero(sizes)
        yield pa.record_batch(
            {
                "cluster": pa.array(full, pa.int32()),
                "size": pa.array(sizes[full]),
                "sums": pa.array([[int(x) for x in sums[c]] for c in full], pa.list_(pa.decimal128(38, 0))),
            }
        )

    parts = index.select("cells", "vector").mapInArrow(
        run, "cluster int, size bigint, sums array<decimal(38,0)>"
    )
    total = parts.select("cluster", "size", F.posexplode("sums").alias("d", "part"))
    rows = total.groupBy("cluster", "d").agg(F.sum("size"), F.sum("part")).collect()
    new = centroids.copy()
    for cluster, d, size, part in rows:
        new[cluster, d] = int(part) // size
    return new


def assigned(index: DataFrame, centroids: np.ndarray, *cut: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector. A squared distance beyond 64 bits is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, *cut)
        for batch in slices(batches):
            to = assigner.nearest(cell_rows(batch), batch.column("vector"))
            far = squares(matrix(batch.column("vector")), centroids[to])
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id"),
                    "cluster": pa.array(to, pa.int32()),
                    "distance": pa.array(far.tolist(), pa.int64()),
                }
            )

    return index.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def starts(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The `count` vectors with the smallest sha256 of `seed:vec_id`, rows without an id last and rows
    with one id by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(mark), "vector").limit(count).select("vector").collect()
    return np.array([r[0] for r in rows], dtype=np.int64).reshape(-1, DIMENSIONS)


def clusters(
    table: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """Every kept vector of `table` (vec_id, embedding) with its cluster: vec_id, cluster, distance
    (squared), cluster_inertia and inertia (distances summed over its cluster and over all), and
    centroid_sha256 (of the final centroid's components, joined by commas).

    Vectors that are null, have other than 64 components or hold a null, infinite or NaN component have
    no row. Repeated rows are vectors of their own. Of equally near centroids the smallest number counts.
    With fewer than `count` vectors each is a centroid; an empty table gives no rows. A vector without
    an id takes part and is a start only if others are too few. Other columns are not read. Whole
    numbers that leave 64 bits, as components beyond 2**62, distances or their sums, raise an error.
    """
    vectors = work_table(whole_vectors(table), "vectors")
    centroids = starts(vectors, count, seed)
    if not len(centroids):
        return table.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    inner = borders(vectors)
    index = work_table(indexed(vectors, inner), "index")
    cut = (inner, *ends(index))
    for _ in range(rounds):
        centroids = moved(index, centroids, *cut)
    out = work_table(assigned(index, centroids, *cut), "clusters")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    inertia = {r[0]: int(r[1]) for r in sums}
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list[int | str], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    return out.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([str(inertia.get(c, 0)) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(str(sum(inertia.values()))).cast("bigint").alias("inertia"),
        of_cluster(marks, "string").alias("centroid_sha256"),
    )
