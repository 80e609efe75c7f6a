"""The corpus pipeline: from raw documents to sampled token sequences."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stintwise.llm.decontaminate import clean
from stintwise.llm.near_dedup import one_of_each
from stintwise.llm.passages import cut_documents
from stintwise.llm.quality import accepted
from stintwise.llm.sampling import sampled_segmentations
from stintwise.session import work_table

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays, that with the smallest doc_id; rows that share a
    doc_id or have none are judged one by one."""
    return one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut from the texts."""
    return cut_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, with or without a doc_id."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every text, with their ids."""
    return sampled_segmentations(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`; each but the last is stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
