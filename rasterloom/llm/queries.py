"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import embedding_dedup, jaccard_join, nearest, packing, piece_fst, quality, secret_scan, suffix_dedup, suffix_tree_lm, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_texts(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are those of a byte-level model: UTF-8 bytes and one end mark."""
    return packing.pack(table(spark, sf_dir, "documents"), "octet_length(text) + 1")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_nearest, op2_embedding_dedup, op3_pieces, op4_quality, op5_lm_scoring, op6_jaccard_join, op7_secrets, op8_packing, op9_suffix_dedup, op10_token_counts)}
ORACLES: dict[str, str] = {}
