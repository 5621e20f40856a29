"""Helpers shared by the corpus operators: word hashing in numpy, ordered positions, joins of facts to rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.session import durable, scratch_path

#: Bytes that end a word: space and the controls 9 to 13 for plain words; all ASCII but a-z and 0-9 for
#: normalised words (texts are lower-cased first).
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
NORMAL = np.ones(256, dtype=bool)
NORMAL[:128] = [chr(i).isdigit() or chr(i).islower() for i in range(128)]

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 2_000_000
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, min(2 * n, CHUNK))
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice ``values[start:end]``, from one running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: ``starts`` and ``ends`` in ``buffer``, ``hashes``, and ``first``: text i has the
    words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: Sequence[bytes], kind: np.ndarray):
        self.buffer = b"\n".join(texts).lower()
        data = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = kind[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(self.starts, begins)
        self.hashes = run_hashes(data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of all runs of n words that lie within a text."""
        m = len(self.starts)
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owner = self.text_of()
        at = np.flatnonzero(owner[: m - n + 1] == owner[n - 1 :])
        return at, run_hashes(self.hashes, at, at + n)


def chunks(lengths: Sequence[int], limit: int = CHUNK):
    """Index ranges of consecutive texts with at most ``limit`` bytes together, one text at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def buckets_for(df: DataFrame) -> int:
    """Number of parts in which an order is cut: some for each shuffle partition."""
    return max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def positions(df: DataFrame, share: Column, order: Sequence[Column], out: str, total: str | None = None) -> DataFrame:
    """Add the zero-based position in the order of ``share`` (from 0 up to 1), then of ``order``.

    The order is cut into equal ranges of ``share``. Rows are numbered inside their range, and the counts of
    the earlier ranges, one row for each, are added. No range holds more than its part of evenly spread shares.
    Neighbouring ranges go to one partition, so partitions follow each other in the order of the positions.
    """
    parts = buckets_for(df)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("_p_cut", F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int"))
    counts = cut.groupBy("_p_cut").agg(F.count(F.lit(1)).alias("_p_n"))
    # As many rows as there are ranges, so a window without a key is bounded.
    before = Window.orderBy("_p_cut").rowsBetween(Window.unboundedPreceding, -1)
    extra = [] if total is None else [F.sum("_p_n").over(Window.partitionBy()).alias(total)]
    offsets = counts.select("_p_cut", F.coalesce(F.sum("_p_n").over(before), F.lit(0)).alias("_p_off"), *extra)
    dealt = cut.withColumn("_p_task", F.expr(f"cast(_p_cut * {tasks} div {parts} as int)")).repartitionById(tasks, F.col("_p_task"))
    numbered = dealt.withColumn("_p_row", F.row_number().over(Window.partitionBy("_p_task", "_p_cut").orderBy(share, *order)) - 1)
    # One row for each range: at most ``parts``, a fixed bound.
    joined = numbered.join(F.broadcast(offsets), "_p_cut")
    return joined.withColumn(out, F.col("_p_row") + F.col("_p_off")).drop("_p_cut", "_p_task", "_p_row", "_p_off")


class Written:
    """A table written below the shared folder: cuts the plan as a checkpoint does, compressed, and can be dropped when it is no longer read."""

    def __init__(self, df: DataFrame, name: str, **options):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of up to so many rows of a few numbers are held in partitions of so many rows, and in FEW at most: each costs
#: files in every shuffle and checkpoint, and Hadoop's local files start processes of their own from an executor.
SMALL = 1 << 18
FEW = 32
EACH = 1 << 15


def few(df: DataFrame, rows: int, each: int = EACH) -> DataFrame:
    return df.coalesce(min(FEW, max(1, -(-rows // each)))) if rows <= SMALL else df


HOT_SHARE = 1000
SALTS = 64


def join_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """Join one row of facts per key to many rows, also where one key holds a large part of the rows.

    ``facts`` has ``key``, unique, and ``_rows``, the number of rows that hold it. Keys with more than
    1/HOT_SHARE of all rows, of which there are fewer than HOT_SHARE, are dealt over SALTS parts on both sides;
    only their list is broadcast. Rows with a NULL key get no facts. ``spread`` names a column that differs between
    the rows of a key.
    """
    stored = durable(facts)
    total = stored.agg(F.sum("_rows")).first()[0] or 0
    hot = stored.where(F.col("_rows") * HOT_SHARE > F.lit(total)).select(F.col(key).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    marked = marked.withColumn("_salt", salt).drop("_hot")
    dealt = stored.withColumn(
        "_salt", F.explode(F.when(F.col("_rows") * HOT_SHARE > F.lit(total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_rows")
    return marked.join(dealt, [key, "_salt"], how).drop("_salt")
