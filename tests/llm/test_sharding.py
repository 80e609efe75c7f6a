import math
import zlib
from collections import Counter, defaultdict


from stintwise.llm.sharding import shard_of, shards
from pyspark.sql import functions as F


def rows():
    out = [(i, "x" * (i % 50) + "é") for i in range(6000)]
    return [*out, (None, None), (None, "a"), (5, "same"), (5, "same"), (6001, None), (6002, "")]


def test_contract(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "t") for r in data], "doc_id bigint, text string, slot int, law string")
    got = shards(df.repartition(7)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in data
    )
    slots = defaultdict(list)
    by_key = defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_key.values())
    moved = sum(r["grown_shard"] == 8 for r in got) / len(got)
    assert abs(moved - 1 / 9) < 0.02
    assert set(slots) == set(range(8)) and all(abs(len(s) - 750) < 120 for s in slots.values())
    assert shards(df.limit(0)).collect() == []


def test_shard_equals_brute_force_and_follows_weights(spark):
    weights = [1.0, 0.0, 2.0, 0.5]
    df = spark.range(4000).select("id", shard_of(F.col("id"), weights).alias("s"))
    hashes = spark.range(200).select(
        "id", *[F.xxhash64(F.col("id").cast("string"), F.lit(k), F.lit(97)).alias(f"h{k}") for k in range(4)]
    )
    want = {}
    for r in hashes.collect():
        best = None
        for k, w in enumerate(weights):
            u = (((r[f"h{k}"] & (2**64 - 1)) >> 11) + 0.5) * 2.0**-53
            if w and (best is None or -w / math.log(u) > best[0]):
                best = (-w / math.log(u), k)
        want[r["id"]] = best[1]
    got = {r["id"]: r["s"] for r in df.collect()}
    assert all(got[i] == s for i, s in want.items())
    share = Counter(got.values())
    assert share[1] == 0
    for k, w in enumerate(weights):
        assert abs(share[k] / 4000 - w / 3.5) < 0.03
