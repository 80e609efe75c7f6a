import sys
from pathlib import Path

import corpus_pipeline
from stintwise.llm.quality import quality_scores
from stintwise.session import work_table

sys.path.insert(0, str(Path(__file__).parent))
from test_near_dedup import brute as components  # noqa: E402
from test_passages import brute as cut_bytes  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force_one_after_another(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    out = stages["quality"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    good = {r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {d: texts[d] for d in good}

    rows = sorted((d, texts[d]) for d in good)
    out2 = stages["near_dedup"](spark, out, FOLDER)
    assert out2.columns == docs.columns
    kept = {doc for doc, n, _, stays in components(rows) if stays}
    assert {r["doc_id"] for r in out2.collect()} == kept

    rows = [r for r in rows if r[0] in kept]
    out3 = stages["passage_dedup"](spark, out2, FOLDER)
    assert out3.columns == docs.columns
    left = {doc: raw.decode("utf-8", "ignore") for doc, *_, raw in cut_bytes(rows)}
    got = {r["doc_id"]: r for r in out3.collect()}
    assert {d: r["text"] for d, r in got.items()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    out4 = stages["decontamination"](spark, out3, FOLDER)
    assert out4.columns == docs.columns
    plain = lambda t: " " + " ".join(w.strip(".,!?*#$%&|").lower() for w in t.split()) + " "
    clean = {d for d, t in left.items() if not any(plain(i["text"]) in plain(t) for i in items)}
    assert {r["doc_id"] for r in out4.collect()} == clean

    ids = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in ids} == clean
    assert all(len(r["ids"]) == r["n_pieces"] for r in ids)


def test_rows_without_or_with_shared_ids_empty_texts_and_extra_columns(spark, tmp_path):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    words = " ".join(f"plain{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [
        (1, words, "en", "a", len(words), "x"),
        (1, words, "en", "a", len(words), "y"),  # a copy that shares the id
        (None, words, "en", "a", len(words), "z"),  # and one without
        (2, other, "en", "a", len(other), "x"),
        (2, "a short one", "en", "a", None, "x"),  # another text of the same id
        (None, item, "en", "a", len(item), "x"),  # leaks, without an id
        (3, "head " + item, "en", "a", 5 + len(item), "x"),
        (4, "", None, None, 0, None),
        (None, None, None, None, None, "w"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        docs = work_table(docs, name)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert kept == sorted([("1", words), ("2", other), ("2", "a short one"), ("4", ""), ("None", "")])
    out = corpus_pipeline.run(spark, str(tmp_path)).where("rank = 1").collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "2", "4", "None"]


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
