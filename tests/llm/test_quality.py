import zlib

import numpy as np
import pytest

from stintwise.llm.quality import (
    Buckets, Model, Settings, features, margins, quality_scores, shape
)

FOLDER = "/root/testdata/sf0.01"


def test_linear_time_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index = np.array([3, 7, 9, 20, 3, 49])
    value = rng.normal(size=6)
    got, _ = margins(model, np.array([4, 6]), index, value)
    for (a, b), score in zip([(0, 4), (4, 6)], got, strict=True):
        want = model.bias + sum(model.weights[index[i]] * value[i] for i in range(a, b))
        want += sum(
            model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j]
            for i in range(a, b)
            for j in range(i + 1, b)
        )
        assert score == pytest.approx(want)


def test_shapes():
    assert shape("THE!!!") == "A!!"
    assert shape("The,") == "Aa,"
    assert shape("x%%%42|") == "a%%0|"


def test_features_of_texts_do_not_depend_on_their_batch():
    texts = ["A b b\nA b b", "", None, "word " * 300, "| x | y"]
    sizes = [11, 0, None, 1500, None]
    ends, index, value = features(texts, sizes, Buckets(64))
    at = 0
    for text, size, end in zip(texts, sizes, ends, strict=True):
        one = features([text], [size], Buckets(64))
        assert index[at:end].tolist() == one[1].tolist()
        assert value[at:end].tolist() == one[2].tolist()
        at = end


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]] == got["held_out"].tolist()
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known["held_out"]]
    assert (known["predicted"] == known["quality"]).mean() >= 0.93
    good = known[known["quality"] == 1]["score"].to_numpy()
    bad = known[known["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() >= 0.95


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", None, 0.5), (1, "a b c", None, 0.1), (None, None, None, 1.0), (2, "", 0, 2.0)],
        "doc_id bigint, text string, n_chars bigint, score double",
    )
    labels = spark.createDataFrame(
        [(1, 1), (None, 1), (2, None)], "doc_id bigint, quality int"
    )
    got = quality_scores(docs, labels, Settings(buckets=64)).collect()
    assert len(got) == 4
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    none = quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []
