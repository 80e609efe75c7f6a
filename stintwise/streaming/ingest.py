"""Incremental ingest of landed sessions, and recompute of what they touch."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stintwise.constants import MIN_SESSION_DRIVERS, SESSION_KEYS
from stintwise.sources.sink import read_sessions, replace_sessions


def land(laps: DataFrame, path: str, ranged: bool = False) -> None:
    """Write sessions to a landing folder the way they arrive: appended, one folder per session. `ranged`
    states that the rows stand by session as they are."""
    dealt = laps if ranged else laps.hint("rebalance", *SESSION_KEYS)
    dealt.write.mode("append").partitionBy(*SESSION_KEYS).parquet(path)


def enough_drivers(laps: DataFrame) -> DataFrame:
    return (
        laps.groupBy(*SESSION_KEYS)
        .agg(F.count_distinct("driver").alias("_drivers"))
        .where(F.col("_drivers") >= MIN_SESSION_DRIVERS)
        .select(*SESSION_KEYS)
    )


def ingest(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    schema: StructType,
    on_sessions: Callable[[DataFrame], None] | None = None,
    files_per_batch: int | None = None,
) -> None:
    """Take in every session with new files, once through the files that are there now.

    A batch says which sessions' folders have new files; only those folders are listed and read, once,
    and staged. The drivers are counted in what was staged, and the sessions that have enough are
    published together. A session whose files come in several batches is replaced until it is complete;
    one with too few drivers is looked at again when more of its files come. All writes replace whole
    sessions, so a batch that is run again does no harm."""

    def take(batch: DataFrame, _: int) -> None:
        touched = batch.distinct().collect()  # a row a session
        if not touched:
            return
        folders = sorted({r["folder"] for r in touched})
        sessions = spark.read.schema(schema).option("basePath", landing).parquet(*folders)
        replace_sessions(sessions, target, accept=enough_drivers, ranged=True)
        if on_sessions is not None:
            keys = StructType([schema[k] for k in SESSION_KEYS])
            on_sessions(spark.createDataFrame([tuple(r[k] for k in SESSION_KEYS) for r in touched], keys).distinct())

    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    folder = F.regexp_replace(F.url_decode("_metadata.file_path"), "/[^/]*$", "")
    query = (
        stream.parquet(landing)
        .select(*SESSION_KEYS, folder.alias("folder"))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class Output(NamedTuple):
    """A published table made from another one. `keys` name its parts (a weekend, a season): a touched
    session makes anew the part it belongs to. `of` says which types of sessions it depends on, None:
    all; `compute` makes the rows of some parts from the source's rows of those parts."""

    path: str
    schema: StructType
    keys: list[str]
    of: frozenset[str] | None
    source: str
    source_schema: StructType
    source_keys: list[str]
    compute: Callable[[DataFrame], DataFrame]


def recompute(spark: SparkSession, outputs: list[Output]) -> Callable[[DataFrame], None]:
    """A batch hook: make anew the parts of `outputs`, in their order, that the touched sessions belong
    to, from those parts of their sources alone, and replace just them."""

    def run(touched: DataFrame) -> None:
        for out in outputs:
            on = touched if out.of is None else touched.where(F.col("session_type").isin(*out.of))
            parts = on.select(*out.keys).distinct()
            if parts.isEmpty():
                continue
            rows = read_sessions(spark, out.source, out.source_schema, out.source_keys, parts)
            replace_sessions(out.compute(rows), out.path, out.keys)

    return run
