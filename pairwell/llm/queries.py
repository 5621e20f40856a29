"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm import chat, decontamination, mixing, ngram_join, pieces, private, quality, sharding, substrings, turns, urls, variants, warc
from pairwell.llm.statements import STATEMENTS


#: The same file on every machine.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digests(sharding.interleave(table(spark, folder, "documents")))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op4_private_data(spark: SparkSession, folder: str) -> DataFrame:
    return private.find_private(table(spark, folder, "documents"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.shingle_components(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.replicate(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra)))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair_report(table(spark, folder, "conversations"))


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(pieces.decode(pieces.encode(table(spark, folder, "documents"), PIECE_MODEL), PIECE_MODEL))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_quality_rules,
        op3_url_filter,
        op4_private_data,
        op5_suffix_dedup,
        op6_ngram_join,
        op7_mixing,
        op8_warc,
        op9_chat,
        op10_decontamination,
        op11_turn_repair,
        op12_pieces,
        op13_spelling_variants,
    )
}

__all__ = ["QUERIES", "STATEMENTS"]
