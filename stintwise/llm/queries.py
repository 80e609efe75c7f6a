"""The registered queries of this subpackage: each applies its operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.llm.centroids import clusters
from stintwise.llm.collocations import collocations
from stintwise.llm.decontaminate import leaks
from stintwise.llm.language import languages_of
from stintwise.llm.main_text import main_texts
from stintwise.llm.near_dedup import near_duplicates
from stintwise.llm.oracles import ORACLES  # noqa: F401
from stintwise.llm.passages import without_repeats
from stintwise.llm.planes import encoded_documents
from stintwise.llm.quality import quality_scores
from stintwise.llm.sampling import sampled_segmentations
from stintwise.llm.sharding import shards
from stintwise.llm.token_counts import token_counts, unigram_vocabulary
from stintwise.llm.topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_gumbel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    return sampled_segmentations(table(spark, sf_dir, "documents"), model)


def op2_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, unknown = unigram_vocabulary(public_tokenizers.path(PIECES))
    return token_counts(table(spark, sf_dir, "documents"), vocabulary, unknown)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    fn.__name__: fn
    for fn in (
        op1_sentencepiece_gumbel_topk,
        op2_bit_plane_tokens,
        op3_minhash_near_dedup,
        op4_token_counts,
        op5_quality_classifier,
        op6_rendezvous_shards,
        op7_language_fusion,
        op8_benchmark_decontamination,
        op9_suffix_array_dedup,
        op10_exact_topk,
        op11_phrase_collocations,
        op12_html_main_text,
        op13_centroid_clusters,
    )
}
