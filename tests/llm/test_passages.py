import random

import numpy as np
import pyarrow as pa
import pytest

from stintwise.llm import passages
from stintwise.llm.passages import without_repeats

SCHEMA = "doc_id bigint, text string, start int, spans int"


def brute(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is None:
            continue
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if doc is not None and first.get(raw[i : i + 50], doc) < doc:
                gone[i : i + 50] = [True] * 50
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), runs, kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "ñandú", "été", "river", "stone", "x", "wandering", "日本"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = [prose(rng.randint(10, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randint(30, 200)], prose(rng.randint(0, 12))]
        rows.append((i * 2, " ".join(parts)))
    for k in range(12):  # edited copies
        text = list(rows[k][1])
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "Z"
        rows.append((200 + k, "".join(text)))
    rows += [(300, None), (301, ""), (302, "ab " * 400), (303, "ab " * 300), (304, "q" * 49)]
    rows += [(305, "All rights reserved. " * 3), (306, "All rights reserved. " * 3), (7, rows[5][1])]
    rows += [rows[40], rows[40], (80, prose(50)), (None, rows[5][1]), (None, None)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(
        (
            (r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
            for r in without_repeats(df).collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("hot", [50_000, 0])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rows = corpus(4)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(4)
    assert got(df) == brute(rows)


def test_windows_of_hot_keys_make_no_collection(spark, monkeypatch):
    """A passage of many documents in different contexts: its windows are settled by aggregates."""
    given, groups = [], passages.map_groups

    def noted(df, keys, *more):
        given.append((keys, df))
        return groups(df, keys, *more)

    monkeypatch.setattr(passages, "HOT", 20)
    monkeypatch.setattr(passages, "map_groups", noted)
    rng = random.Random(7)
    noise = lambda: "".join(rng.choices("abcdefghij ", k=60))
    shared = "this passage stands in every one of the documents, between other words each time. "
    rows = [(i, noise() + shared + noise()) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(df) == brute(rows)
    (sent,) = [df for keys, df in given if keys == ["collection"]]
    many = [r["count"] for r in sent.groupBy("collection").count().collect()]
    assert max(many, default=0) <= 20


def test_given_documents_equal_brute_force(spark):
    rows = [
        tuple(r)
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        .select("doc_id", "text")
        .collect()
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert got(df) == brute(rows)


def test_no_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_collections_hold_what_may_be_shared_once(monkeypatch):
    """Segments that share 20 bytes and no window stay out of the transform, the others go in from their
    first to their last shared window, equal ones once."""
    given, transform = [], passages.collection_bwt
    monkeypatch.setattr(
        passages, "collection_bwt", lambda text, ends: given.append((text.tobytes(), len(ends))) or transform(text, ends)
    )
    shared = b"these bytes are the same in three of the documents here"  # 55
    alone = [b"twenty bytes of seed" + bytes([97 + i]) * 40 for i in range(6)]
    cuts = [b"AAAA" + shared + b"BBB", b"CC" + shared, shared + b"DDDDDD", *alone]
    rows = pa.table(
        {
            "bytes": pa.array(cuts, pa.binary()),
            "doc": pa.array([5, 3, 8, *range(20, 26)], pa.int64()),
            "start": pa.array([100, 0, 7, *[0] * 6], pa.int32()),
        }
    )
    out = passages.collection_spans(rows).to_pydict()
    assert given == [(shared, 1)]
    assert sorted(zip(out["doc"], out["start"], out["n"], strict=True)) == [(5, 104, 6), (8, 7, 6)]
    assert passages.collection_spans(rows.slice(3)).num_rows == 0


@pytest.mark.parametrize("size", [0, 19, 49, 50, passages.BLOCK + 19, 2 * passages.BLOCK + 50])
def test_fingerprints_are_polynomials_across_blocks(size):
    text = np.frombuffer(random.Random(size).randbytes(size), np.uint8)
    for width, prints in zip([20, 50], passages.rolling(text, [20, 50]), strict=True):
        values = [int(passages._BYTES[b]) for b in text]
        some = {0, 1, size // 2, passages.BLOCK - width, passages.BLOCK - 1, passages.BLOCK, size - width}
        at = [i for i in some if 0 <= i <= size - width]
        want = [
            sum(v * pow(passages._BASE, width - 1 - k, 1 << 64) for k, v in enumerate(values[i : i + width])) % (1 << 64)
            for i in at
        ]
        assert len(prints) == max(size - width + 1, 0)
        assert prints[at].tolist() == want
