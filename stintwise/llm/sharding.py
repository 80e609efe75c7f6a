"""Sharding by rendezvous hashing: every record key is scored against every shard, and the highest
weighted score takes it. A record's shard depends on its key and the shards alone, so one more shard
takes records only into itself, and a removed one gives up only its own."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.skew import row_numbers

SHARDS = 8
LAW = "key"


def shard_of(key: Column, weights: list[float], seed: int = 97) -> Column:
    """The shard of a key: the largest of -w / ln(u), u a hash of (key, shard) in (0, 1); ties to the
    smaller shard. Shards of weight 0 get nothing."""
    real = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not real:
        raise ValueError("no shard has a weight above 0")
    stable = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scored = []
    for shard, weight in real:
        bits = F.shiftrightunsigned(F.xxhash64(stable, F.lit(shard), F.lit(seed)), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        scored.append(
            F.struct((F.lit(weight) / -F.log(u)).alias("score"), F.lit(-shard).alias("back"))
        )
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["back"]).cast("int")


def shards(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs` (doc_id,
    text, any more). `size` is the UTF-8 length of the text (null: 0) plus 1, `slot` counts a shard's
    rows from 0 by doc_id, size and checksum, `grown_shard` is the shard with one more of the mean
    weight.

    A null doc_id is a key of its own; repeated rows go to one shard with slots of their own; the
    checksum of a null text is that of an empty one. Slots are given over stored ranges, so a shard
    of any size never meets in one task. Other columns are not read."""
    weights = weights or [1.0] * SHARDS
    more = [*weights, sum(weights) / len(weights)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id")
    placed = docs.select(
        key.cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, more).alias("grown_shard"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    numbered = row_numbers(placed, ["shard"], order, "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("slot") - 1).cast("bigint").alias("slot"),
        "grown_shard",
    )
