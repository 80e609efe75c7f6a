"""Arrow batches in pieces of bounded size."""

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PIECE = 2_000_000


def give_back() -> None:
    """Memory that a task has let go of goes back to the machine: Spark keeps Python workers from task to
    task, and what one task freed inside a worker helps no other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def short_batches(spark: SparkSession, size: int = PIECE) -> Iterator[None]:
    """While this lasts, a batch that goes from Spark to Python ends with the row that takes it to `size`
    bytes: rows of some megabytes go one by one. Then the session is as it was."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a text or binary `column` hold about `size` bytes together; a
    longer row stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_pieces(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str | StructType,
    column: str = "text",
    size: int = PIECE,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """`df` through a function of bounded pieces. `make` is called once per task, so that what it
    sets up (memos, models) lives as long as the task; `done` empties what lives longer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in pieces(batch, column, size):
                out = step(piece)
                if out is not None and out.num_rows:
                    yield out
        del step
        if done is not None:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def map_groups(
    df: DataFrame,
    keys: list[str],
    step: Callable[[pa.Table], pa.RecordBatch],
    schema: str,
    column: str,
    size: int = PIECE,
) -> DataFrame:
    """`df` through a function of whole groups. Rows are shuffled and sorted by `keys`; `step` gets
    runs of groups, numbered in a column `_group`, that hold about `size` bytes in `column`
    together, or one larger group. Groups must be of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        weight, at, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            row = pa.StructArray.from_arrays([batch.column(k) for k in keys], keys)
            new = [True] * batch.num_rows
            new[0] = row[0].as_py() != last
            change = pc.fill_null(
                functools.reduce(
                    pc.or_,
                    [pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, len(new) - 1)) for k in keys],
                ),
                True,
            ).to_pylist()
            new[1:] = change
            last = row[-1].as_py()
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            group = np.cumsum(new) + at
            at = int(group[-1])
            table = pa.Table.from_batches([batch]).append_column("_group", pa.array(group))
            start = 0
            for i, (fresh, n) in enumerate(zip(new, lengths, strict=True)):
                if fresh and weight > size:
                    held.append(table.slice(start, i - start))
                    out = step(pa.concat_tables(held).combine_chunks())
                    if out.num_rows:
                        yield out
                    held, weight, start = [], 0, i
                weight += n
            held.append(table.slice(start))
        if held:
            out = step(pa.concat_tables(held).combine_chunks())
            if out.num_rows:
                yield out
        held.clear()
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
