"""Mixing sources to target weights by Poisson replication.

A source with the share ``w`` of the target and ``size`` bytes gets the mean repetition rate
``w * epochs * total / size``. Each document is repeated as often as a Poisson variate with that mean says, found by
inverting the distribution at a number hashed from the seed, the id and the text. A mean over ``CHUNK_MEAN`` is split
into equal parts with a hash each, whose sum has the same distribution, so no mean is too large to invert. The
copies are then put into the order of a second hash.

Defined cases: NULL source is a source of its own and never in ``weights``; NULL text counts as empty (16 bytes of
overhead, like any document); a source without a weight gets none and vanishes; equal rows get equal counts; an
empty table gives no rows; all columns of the input stay, and ``copy``, ``repeats``, ``position`` replace columns of
that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import positions
from pairwell.session import durable

CHUNK_MEAN = 16.0
#: Terms of the distribution: beyond them, less than 2^-53 is left for means up to CHUNK_MEAN.
TERMS = 96
BROADCAST_SOURCES = 10_000


def hashed_share(*parts: Column) -> Column:
    """A number between 0 and 1 from 52 bits of md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """``_source, _none, mean`` per source. Without weights, a source weighs its size to ``power``."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16
    sizes = docs.groupBy(
        F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")
    ).agg(F.sum(size.cast("long")).alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
        weight = F.when(~F.col("_none"), F.coalesce(given[F.col("_source")], F.lit(0.0))).otherwise(0.0) if weights else F.lit(0.0)
    stored = durable(sizes.withColumn("_weight", weight.cast("double")))
    sums = stored.agg(F.sum("_size"), F.sum("_weight")).first()
    if not sums[0] or not sums[1]:
        return stored.select("_source", "_none", F.lit(0.0).alias("mean"))
    mean = F.col("_weight") / float(sums[1]) * (float(epochs) * float(sums[0])) / F.col("_size")
    return stored.select("_source", "_none", F.round(mean, 9).alias("mean"))


def inverted(mean: Column, pieces: Column) -> Column:
    """Distribution function of one piece, as an array of TERMS values."""
    part = mean / pieces
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf")),
        lambda acc, j: F.struct(
            (acc["p"] * part / j).alias("p"),
            F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * part / j).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
    seed: int = 29,
) -> DataFrame:
    """All copies of all documents in a global random order: the input's columns, copy, repeats, position."""
    facts = durable(
        rates(docs, weights, power, epochs)
        .withColumn("_pieces", F.greatest(F.lit(1), F.ceil(F.col("mean") / CHUNK_MEAN)).cast("int"))
        .withColumn("_cdf", inverted(F.col("mean"), F.col("_pieces")))
        .select("_source", "_none", "_pieces", "_cdf")
    )
    kept = [c for c in docs.columns if c not in ("copy", "repeats", "position")]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*kept).alias("_row"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_none"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.md5(text.cast("binary")).alias("_text"),
    )
    # Few sources: the counted list is broadcast. Otherwise adaptive execution splits the large ones.
    few = facts.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(facts) if few else facts, ["_source", "_none"])
    one = lambda i: F.size(F.filter("_cdf", lambda x: x <= hashed_share(F.lit(str(seed)), i.cast("string"), F.col("_id"), F.col("_text"))))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("_pieces")), F.lit(0), lambda acc, i: acc + one(i))
    copies = rows.withColumn("_repeats", drawn).where(F.col("_repeats") > 0)
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats"))))
    copies = copies.withColumn("_key", hashed_share(F.lit(f"{seed} order"), F.col("_copy").cast("string"), F.col("_id"), F.col("_text")))
    copies = copies.select("_row", "_copy", "_repeats", "_key", "_id")
    placed = positions(copies, F.col("_key"), [F.col("_id"), F.col("_copy")], "_at")
    return placed.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.col("_copy").alias("copy"),
        F.col("_repeats").alias("repeats"),
        F.col("_at").cast("long").alias("position"),
    )
