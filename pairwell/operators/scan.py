"""Ordered scans without a single hot task.

A window over a group puts the whole group into one task. Groups here may hold a third of all rows,
so running sums, ranks and quantiles split each group into blocks first:

* ``cumulate`` splits by value. Block limits are approximate quantiles, fetched once as a short list
  of literals, so the block of a row is a plain comparison tree that stays in generated code.
* ``hash_ranks`` splits by the leading digits of the hash that defines the order.
* ``global_positions`` splits any composite order with Spark's range partitioning.

Every scan is exact. The limits only decide which task does which part of the work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.session import durable

MAX_BLOCKS = 256


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Equi join in which NULL keys meet each other; the key columns of ``left`` are kept.

    ``small`` says that the right side has been counted and may be broadcast.
    """
    if not on:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right
    for key in on:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    left_null = {f.name: f.nullable for f in left.schema.fields}
    right_null = {f.name: f.nullable for f in right.schema.fields}

    def same(key: str) -> Column:
        # Plain equality where NULL cannot occur: it keeps an existing partitioning usable.
        mine, other = left[key], renamed[f"_r_{key}"]
        return mine.eqNullSafe(other) if left_null[key] and right_null[key] else mine == other

    condition = reduce(lambda a, b: a & b, [same(k) for k in on])
    joined = left.join(F.broadcast(renamed) if small else renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in on])


BROADCAST_ROWS = 100_000


def measured_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of per-group facts back to its rows without shuffling the rows by group.

    The facts are stored and counted first. Up to ``BROADCAST_ROWS`` of them are broadcast, so a hot
    group stays spread over its tasks; more of them are joined the ordinary way.
    """
    stored = durable(right)
    return null_safe_join(left, stored, on, how, small=stored.count() <= BROADCAST_ROWS)


def _with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_key``: the keys as one struct, which is never NULL and equals itself with NULLs inside.

    Windows, aggregates and joins on it share one partitioning, so rows are shuffled once.
    """
    return df.withColumn("_key", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0))


def value_bounds(df: DataFrame, column: str, blocks: int | None = None) -> list[float]:
    """Ascending distinct block limits of a numeric column, at most ``MAX_BLOCKS - 1`` of them."""
    if blocks is None:
        blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(MAX_BLOCKS, blocks))
    if blocks == 1:
        return []
    probabilities = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), probabilities, 8 * blocks)).first()[0]
    return sorted(set(found or []))


def block_of(column: Column, bounds: Sequence[float]) -> Column:
    """Index of the block that holds the value, as a balanced tree of comparisons."""
    value = column.cast("double")

    def build(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(float(bounds[middle])), build(low, middle)).otherwise(build(middle + 1, high))

    return build(0, len(bounds))


def cumulate(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``<v>_before`` and ``<v>_total`` per key for each value column.

    ``df`` has one row per (keys, order): pre-aggregate ties first. ``_before`` sums the rows of the
    key with a smaller order value.
    """
    if bounds is None:
        bounds = value_bounds(df, order)
    if not bounds:
        # A single block: the caller knows that groups are short, or there is hardly a distinct value.
        whole = Window.partitionBy(*keys)
        below = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {f"{v}_before": F.coalesce(F.sum(v).over(below), F.lit(0)) for v in values}
            | {f"{v}_total": F.sum(v).over(whole) for v in values}
        )
    marked = _with_key(df, keys).withColumn("_blk", block_of(F.col(order), bounds))
    part = ["_key", "_blk"]
    inner = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values})
    per_block = marked.groupBy(*part).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    # One row per key and block: a key has at most MAX_BLOCKS rows here.
    earlier = Window.partitionBy("_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    offsets = per_block.select(
        *part,
        *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"{v}_total") for v in values],
    )
    joined = null_safe_join(marked, offsets, part)
    joined = joined.withColumns({f"{v}_before": F.col(f"_in_{v}") + F.col(f"_off_{v}") for v in values})
    return joined.drop(*part, *[f"_in_{v}" for v in values], *[f"_off_{v}" for v in values])


def exact_percentiles(
    df: DataFrame,
    column: str,
    probabilities: dict[str, float],
    keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Percentiles with linear interpolation, per key, from value counts.

    NULL and NaN are ignored. ``count`` names a column that says how often a row counts. Returns the keys, one column per name in ``probabilities`` and ``n``.
    """
    keys = list(keys)
    value = F.col(column).cast("double")
    counts = (
        df.select(*keys, value.alias("_x"), (F.lit(1) if count is None else F.col(count)).alias("_c"))
        .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
        .groupBy(*keys, "_x")
        .agg(F.sum("_c").alias("_n"))
    )
    placed = cumulate(counts, keys, "_x", ["_n"], bounds)
    first, last, total = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1, F.col("_n_total")
    picks = []
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (total - 1)
        low, high = F.floor(spot), F.ceil(spot)
        picks.append(F.max(F.when((first <= low) & (low <= last), F.col("_x"))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when((first <= high) & (high <= last), F.col("_x"))).alias(f"_hi_{name}"))
    found = placed.groupBy(*keys).agg(*picks, F.max("_n_total").alias("n"))
    out = [*keys]
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("n") - 1)
        share = spot - F.floor(spot)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * share).alias(name))
    return found.select(*out, "n")


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of a fixed list of columns, as driver scalars (one number per column)."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "_name", "_value"
    )
    rows = exact_percentiles(long, "_value", {"median": 0.5}, keys=["_name"]).collect()
    found = {r["_name"]: r["median"] for r in rows}
    return {c: found.get(c) for c in columns}


def md5_digits(*parts: Column | str) -> Column:
    """First 15 hex digits of md5 over the ``|``-joined parts; their order as texts is that of the numbers."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.substring(F.md5(joined), 1, 15)


def md5_number(*parts: Column | str) -> Column:
    """First 15 hex digits of md5 over the ``|``-joined parts, as a non-negative long."""
    return F.conv(md5_digits(*parts), 16, 10).cast("long")


def hash_ranks(
    df: DataFrame, keys: Sequence[str], hash_column: str, tie: Sequence[str], out: str, total: str | None = None
) -> DataFrame:
    """Zero-based rank within the keys in the order of a 60-bit hash, then of the tie columns.

    Hashes spread evenly, so their top digits split a hot key into even blocks. ``total`` names a
    column for the size of the key.
    """
    marked = _with_key(df, keys).withColumn("_blk", F.shiftright(F.col(hash_column), 52).cast("int"))
    part = ["_key", "_blk"]
    inner = Window.partitionBy(*part).orderBy(hash_column, *tie)
    placed = marked.withColumn("_place", F.row_number().over(inner) - 1)
    joined = _add_offsets(placed, marked, part, out, total)
    return joined.drop("_blk")


def _add_offsets(placed: DataFrame, rows: DataFrame, part: list[str], out: str, total: str | None) -> DataFrame:
    """Turn places inside blocks into places inside keys, with the row counts of earlier blocks."""
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy("_key")
    earlier = by_key.orderBy(part[1]).rowsBetween(Window.unboundedPreceding, -1)
    extra = [] if total is None else [F.sum("_n").over(by_key).alias(total)]
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), *extra)
    joined = null_safe_join(placed, offsets, part)
    return joined.withColumn(out, (F.col("_place") + F.col("_off")).cast("long")).drop("_key", "_place", "_off")


def global_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Zero-based position within the keys for any composite order that has no ties.

    Rows are range-partitioned by (keys, order) and stored, so that the partition number of a row is
    fixed; each partition then needs only the counts of the partitions before it.
    """
    key_columns = [F.col(k).asc_nulls_first() for k in keys]
    order_columns = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        df.repartitionByRange(parts, *key_columns, *order_columns).withColumn("_pid", F.spark_partition_id())
    )
    ranged = _with_key(ranged, keys)
    part = ["_key", "_pid"]
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy(*order_columns)) - 1)
    return _add_offsets(placed, ranged, part, out, None).drop("_pid")


WINDOW_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group; pre-aggregated before the shuffle."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()
    return int(row[0] or 0)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One-based row number within the keys.

    A plain window serves as long as no group exceeds ``window_rows`` (measured); larger groups
    go through ``global_positions``. The order must have no ties.
    """
    if largest_group(df, keys) <= window_rows:
        order_columns = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_columns)).cast("long"))
    return global_positions(df, keys, order, out).withColumn(out, F.col(out) + 1)
