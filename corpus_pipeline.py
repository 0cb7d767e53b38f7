"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontamination, packing, quality, similarity_join, substring_dedup
from stratalog.llm.common import small_batches, stored
from stratalog.llm.tokens import word_tokenizer_path
from stratalog.session import ship_package


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package on its workers and batches that suit long texts."""
    return small_batches(ship_package(spark))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(spark, docs, labels)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return similarity_join.keep_one(ready(spark), docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; a text that loses nothing stays as it is."""
    return substring_dedup.remove_repeats(ready(spark), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(spark, docs, benchmark)


def minimum_slack_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows."""
    return packing.pack_documents(ready(spark), docs, word_tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", minimum_slack_packing),
]

#: A trained model and a tokenizer are not SQL: tests/llm compares every stage and the documents that run() keeps with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
