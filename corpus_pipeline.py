"""A training-data pipeline over the table documents: five operators, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and reads it again as the next one's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import jaccard_join, packing, quality, secret_scan, suffix_dedup
from rasterloom.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`: the id, or for a row without one a large number made of its text, so that decisions reach it.

    Rows that share an id, and rows without one that share a text, are one document to the operators.
    """
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2) + F.lit(1 << 62)
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), own))


def kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(keys.select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, null and empty texts judged like any other; each row of a
    repeated id stays or goes with it. An empty table stays empty; other columns go."""
    rows = keyed(docs)
    found = quality.classify(rows.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept(rows, found.filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: five words, similarity 0.8.

    Documents without words link with nothing and stay. Rows without an id come after all that have one. Every row of
    the id that stays does. An empty table stays empty; other columns go.
    """
    rows = keyed(docs)
    found = jaccard_join.join(rows.select(F.col("key").alias("doc_id"), "text"), width=5, percent=80)
    return kept(rows, found.filter("doc_id = component_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that start earlier; a row without an id is compared with nothing and
    stays as it is, null texts stay null, and documents of which nothing is left go."""
    return suffix_dedup.clean(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets marked out; null texts stay null."""
    return secret_scan.redact(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of each piece of each document; a null text has a row without a bin."""
    return packing.pack(docs, "octet_length(text) + 1")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the suffix order of bytes; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
