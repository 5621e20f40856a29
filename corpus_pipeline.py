"""From raw documents to training shards: quality, near copies, benchmark passages, mixture, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwell.llm import decontamination, mixing, ngram_join, quality, sharding
from pairwell.llm.queries import table
from pairwell.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a quality rule rejects."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return ngram_join.keep_one(docs)


def untested_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with benchmark passages."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until the sources have their target weights; a copy is a row, written at its position."""
    placed = mixing.replicate(docs)
    return placed.sortWithinPartitions("position").select(*[placed[f"`{c}`"] for c in docs.columns])


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Moves every row with all its columns into its shard, in the order of the slots."""
    return sharding.interleave(docs).sortWithinPartitions("shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", untested_documents),
    ("mixing to target weights", mixed_documents),
    ("sharding", sharded_documents),
]

#: The join's components and the hashed order of the shards are not expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
