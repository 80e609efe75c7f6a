"""Published tables of sessions: many sessions replaced at once, or none.

A store has data folders, one for each write, and manifests. A manifest is one small Parquet file that
says of every session in which write its rows are. A write stages its files, works out the next manifest
and moves that into place under the next number; the move is the only step that readers can see. A
reader is bound to the manifest that is the last when it asks, and stays with it: files of older writes
stay until `drop_unused`. A write that fails leaves files that no manifest names.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stintwise.constants import SESSION_KEYS

VERSION = "_version"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object)"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def last_manifest(spark: SparkSession, path: str) -> int:
    """The number of the newest manifest; 0 if there is none."""
    found = names_in(spark, f"{path}/manifests")
    return max((int(n.split(".")[0]) for n in found if n[0] not in "._"), default=0)


def manifest(spark: SparkSession, path: str, number: int, like: StructType, keys: list[str]) -> DataFrame:
    """(keys, _version) of manifest `number`; manifest 0 is empty."""
    schema = StructType([*[like[k] for k in keys], StructField(VERSION, StringType())])
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifests/{number}.parquet")


def moved_into_place(spark: SparkSession, staged: str, target: str) -> bool:
    """Move the one data file of the folder `staged` to `target`, unless there is one."""
    fs, folder = file_system(spark, staged)
    part = next(n for n in names_in(spark, staged) if n.startswith("part-"))
    _, goal = file_system(spark, target)
    done = not fs.exists(goal) and fs.rename(file_system(spark, f"{staged}/{part}")[1], goal)
    fs.delete(folder, True)
    return done


def replace_sessions(
    df: DataFrame,
    path: str,
    keys: list[str] = SESSION_KEYS,
    accept: Callable[[DataFrame], DataFrame] | None = None,
    ranged: bool = False,
) -> int:
    """Replace the sessions of `df` and leave all others alone; the number of the manifest that does so.
    Keys must not be null. `accept` picks, from the staged rows, the sessions (keys) that are published;
    the others are as if they were not in `df`. If another write came first, its manifest is the one that
    this write goes on from. Without rows nothing is published. `ranged` states that the rows stand by
    `keys` as they are, such as files of one session each, and need not be dealt anew."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/data/{VERSION}={version}"
    (df if ranged else df.hint("rebalance", *keys)).write.partitionBy(*keys).parquet(folder)
    staged = spark.read.schema(df.schema).parquet(folder)
    new = accept(staged) if accept else staged.select(*keys).distinct()
    new = new.select(*keys, F.lit(version).alias(VERSION))
    while True:
        number = last_manifest(spark, path)
        old = manifest(spark, path, number, df.schema, keys)
        kept = old.join(new.select(*keys), keys, "left_anti")
        file_system(spark, path)[0].mkdirs(file_system(spark, f"{path}/manifests")[1])
        target = f"{path}/manifests/_staged-{uuid.uuid4().hex}"
        kept.unionByName(new).coalesce(1).write.parquet(target)  # a row a session
        if moved_into_place(spark, target, f"{path}/manifests/{number + 1}.parquet"):
            return number + 1


def read_sessions(
    spark: SparkSession,
    path: str,
    schema: StructType,
    keys: list[str] = SESSION_KEYS,
    only: DataFrame | None = None,
    number: int | None = None,
) -> DataFrame:
    """The published rows, as of manifest `number` or the newest one now. `only` names a few sessions, by
    all or some of the keys: their folders alone are listed and read."""
    if number is None:
        number = last_manifest(spark, path)
    wanted = manifest(spark, path, number, schema, keys)
    base = f"{path}/data"
    if only is not None:
        by = [k for k in keys if k in only.columns]
        rows = wanted.join(only.select(*by).distinct(), by, "left_semi").collect()
        folders = ["/".join([base, *(f"{k}={r[k]}" for k in (VERSION, *keys))]) for r in rows]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", base).parquet(*folders).select(*schema.names)
    if number == 0:
        return spark.createDataFrame([], schema)
    whole = spark.read.schema(StructType([*schema, StructField(VERSION, StringType())])).parquet(base)
    return whole.join(wanted, [*keys, VERSION], "left_semi").select(*schema.names)


def drop_unused(spark: SparkSession, path: str, schema: StructType, keys: list[str] = SESSION_KEYS, keep: int = 2) -> None:
    """Delete the data of writes that none of the last `keep` manifests names, and older manifests. Readers
    bound to those, and writes under way, must have ended."""
    last = last_manifest(spark, path)
    kept = range(max(1, last - keep + 1), last + 1)
    used = {
        r[0]
        for n in kept
        for r in manifest(spark, path, n, schema, keys).select(VERSION).distinct().collect()
    }
    fs, _ = file_system(spark, path)
    for name in names_in(spark, f"{path}/data"):
        if name.startswith(f"{VERSION}=") and name.split("=")[1] not in used:
            fs.delete(file_system(spark, f"{path}/data/{name}")[1], True)
    for name in names_in(spark, f"{path}/manifests"):
        if name[0] not in "._" and int(name.split(".")[0]) not in kept:
            fs.delete(file_system(spark, f"{path}/manifests/{name}")[1], False)
