"""Sharding by proportional stratified interleaving.

Rows are put into a seeded random order within their source. The row with rank r of a source with n rows has the
fractional rank (r + 1/2) / n. Sorted by it, the sources are interleaved in proportion, and cutting that order into
equal runs gives shards whose counts differ by one at most and which all have the mixture of the whole. All columns of
the input, the text among them, are moved: partitions follow each other by shard and slot.

Defined cases: NULL source is a source of its own; NULL text has no bytes and counts as empty; rows that are equal
in id and text are interchangeable, each gets a slot of its own, spread over the shards like those of other rows; with fewer rows than shards the last ones stay empty; an
empty table gives no rows; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import buckets_for, positions

#: A bound on what is broadcast to find copies; with more of them, more rows are moved once more.
BUCKETS = 1 << 20
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Add ``_nth``, different for rows that are equal in source, id and text: else they would have one hash and neighbouring slots.

    Equal rows are found by counting hashes. Only rows in the buckets of hashes that occur several times, of which there are
    at most ``BUCKETS``, are moved for it; the others are numbered 0 where they are. Copies are numbered within the input
    partition that they come from, so no task gets all copies of a row, in an order that is the same when a task is repeated.
    """
    equal = F.xxhash64("_source", "_none", "doc_id", "text_crc32", "size")
    bucket = F.pmod(equal, F.lit(BUCKETS)).cast("int")
    several = rows.groupBy(equal.alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = several.select(F.pmod("_key", F.lit(BUCKETS)).cast("int").alias("_bucket")).distinct().withColumn("_copied", F.lit(True))
    marked = rows.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket", "left").drop("_bucket")
    single = marked.where("_copied is null").withColumn("_nth", F.lit(0).cast("long"))
    copies = marked.where("_copied").withColumn("_from", F.spark_partition_id())
    same = Window.partitionBy("_source", "_none", "doc_id", "text_crc32", "size", "_from").orderBy(F.xxhash64(F.to_json("kept")))
    copies = copies.withColumn("_nth", F.row_number().over(same) + F.shiftleft(F.col("_from").cast("long"), 32)).drop("_from")
    return single.unionByName(copies).drop("_copied")


def interleave(docs: DataFrame, shards: int = 40, seed: int = 17, keep: Sequence[str] | None = None) -> DataFrame:
    """``doc_id``, the columns ``keep`` (all, if None) and size, text_crc32, law, shard, slot, grown_shard for every row."""
    parts = buckets_for(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c not in ADDED and c != "doc_id"]
    rows = docs.select(
        F.col("doc_id"),
        F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("kept"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_none"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = numbered_copies(rows).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "_nth"))
    # A source may hold a third of all rows: its order is cut into parts by the hash.
    rows = rows.withColumn("_part", F.pmod("_h", F.lit(parts)).cast("int"))
    keys = ["_source", "_none", "_part"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    source = Window.partitionBy("_source", "_none")
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(source.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(source).alias("_of"),
    )
    order = ["_h", "doc_id", "text_crc32", "size", "_nth"]
    ranked = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).join(offsets, keys)
    share = (2 * (F.col("_row") + F.col("_off")) + 1) / (2 * F.col("_of"))
    ranked = ranked.withColumn("_share", share)
    placed = positions(ranked, F.col("_share"), [F.col(c) for c in ("_source", "_none", *order)], "_at", "_all")
    exact = F.expr(f"_at * {shards} div _all")
    return placed.withColumn("shard", exact.cast("int")).select(
        "doc_id",
        *[F.col("kept")[c].alias(c) for c in keep],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_at") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def digests(sharded: DataFrame) -> DataFrame:
    """The rows of ``interleave`` with the size and the CRC of the texts as they are in the shards, instead of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        "grown_shard",
    )
