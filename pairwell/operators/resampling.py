"""Bootstrap resamples kept as packed counts instead of one row for each draw.

Slot i of replicate b draws the person with rank ``md5(seed, b, stratum, i) mod n``. A task makes the
draws of a replicate by whole arrays and sends, for each block of ranks, the counts of its persons, about
one byte a draw before compression. Figures per replicate come from two steps over such blocks:

* blocks of ranks meet their persons, where sums are added up and counts are dealt out by score;
* blocks of the score order win their pairs inside; their ends may be tied with the next blocks and are
  returned as segments of a single score, so that equal scores are added up over all blocks.

No task holds more than ``BLOCK`` persons with their counts, or ``CHUNK`` draws.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.functions import expressions as E
from pairwell.operators.scan import global_positions, hash_ranks, md5_number, null_safe_join
from pairwell.session import durable

#: Persons of a block of ranks, or of a block of the score order.
BLOCK = 1 << 14
#: Draws that a task makes at once.
CHUNK = 1 << 24
#: Replicates that are turned into floating numbers at once.
STEP = 128
_LANE = 1 << 13
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = (np.abs(np.sin(np.arange(1, 65, dtype="f8"))) * 4294967296.0).astype("u4")
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_lane(words: list) -> np.ndarray:
    """First 60 bits of the md5 of one-block messages, given as 16 words (arrays or single numbers)."""
    a, b, c, d = (np.full(_width(words), v, "u4") for v in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += _SINES[i]
        f += words[g]
        turn = _SHIFTS[i // 16][i % 4]
        turned = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    high = (a + np.uint32(_START[0])).byteswap().astype("u8")
    low = (b + np.uint32(_START[1])).byteswap().astype("u8")
    return ((high << np.uint64(32)) | low) >> np.uint64(4)


def _width(words: list) -> int:
    return max(w.size for w in words if isinstance(w, np.ndarray))


def md5_numbers(prefix: bytes, start: int, stop: int) -> Iterator[np.ndarray]:
    """``md5_number`` of the prefix followed by each whole number from ``start`` up to ``stop``, in pieces."""
    while start < stop:
        digits = len(str(start))
        end = min(stop, 10**digits, start + _LANE)
        length = len(prefix) + digits
        if length > 55:
            texts = (hashlib.md5(prefix + str(i).encode(), usedforsecurity=False).hexdigest() for i in range(start, end))
            yield np.array([int(t[:15], 16) for t in texts], "u8")
        else:
            fixed = np.frombuffer((prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little"), "<u4")
            words: list = list(fixed)
            rest = np.arange(start, end, dtype="u4" if end <= 1 << 32 else "u8")
            for place in range(length - 1, len(prefix) - 1, -1):
                rest, digit = np.divmod(rest, rest.dtype.type(10))
                words[place // 4] = words[place // 4] | ((digit.astype("u4") + np.uint32(48)) << np.uint32(8 * (place % 4)))
            yield _md5_lane(words)
        start = end


def _packed(drawn: np.ndarray, n: int) -> Iterator[tuple[int, bool, bytes]]:
    """Sorted draws by block: its number, whether single draws are listed, and the counts or the draws."""
    edges = np.searchsorted(drawn, np.arange(0, n + BLOCK, BLOCK))
    for block in range(len(edges) - 1):
        mine = drawn[edges[block] : edges[block + 1]] - block * BLOCK
        size = min(BLOCK, n - block * BLOCK)
        if len(mine) * 4 < size:
            yield block, True, zlib.compress(mine.astype("<u2").tobytes(), 1)
            continue
        counts = np.bincount(mine, minlength=size)
        yield block, False, zlib.compress(counts.astype("u1" if counts.max() < 256 else "<u4").tobytes(), 1)


def _unpacked(listed: bool, size: int, packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    if listed:
        return np.bincount(np.frombuffer(raw, "<u2"), minlength=size)
    return np.frombuffer(raw, "u1" if len(raw) == size else "<u4")


def _counts(packed: pd.DataFrame, size: int, replicates: int) -> np.ndarray:
    """Replicates by ranks of a block."""
    out = np.zeros((replicates, size), "u1")
    for b, listed, z in zip(packed["b"], packed["listed"], packed["z"]):
        found = _unpacked(listed, size, z)
        if out.dtype == np.uint8 and int(found.max(initial=0)) + int(out[b - 1].max(initial=0)) > 255:
            out = out.astype("u4")
        out[b - 1] += found.astype(out.dtype)
    return out


class Resamples:
    """Resamples with replacement of persons, inside each stratum; replicates count from 1."""

    def __init__(self, persons: DataFrame, person: str, replicates: int, strata: Sequence[str] = (), seed: int = 42):
        keyed = persons.withColumn("_s", E.composite_key([F.col(c) for c in strata]) if strata else F.lit("_all_"))
        keyed = keyed.withColumn("_h", md5_number(str(seed), F.col(person)))
        self.person, self.replicates, self.seed = person, replicates, str(seed)
        self.ranked = durable(hash_ranks(keyed, ["_s"], "_h", [person], "_r").drop("_h"))
        self._stored: DataFrame | None = None

    def store(self) -> Resamples:
        """Keep the draws for several figures."""
        self._stored = durable(self.draws())
        return self

    def draws(self) -> DataFrame:
        """``_s, _k, b, size, listed, z``: packed counts of every block of ranks."""
        if self._stored is not None:
            return self._stored
        seed = self.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n, low = row["n"], row["low"]
                    drawn = np.empty(min(CHUNK, n - low), "u4" if n < 1 << 32 else "u8")
                    at = 0
                    for numbers in md5_numbers(f"{seed}|{row['b']}|{row['_s']}|".encode(), low, low + len(drawn)):
                        drawn[at : at + len(numbers)] = numbers % np.uint64(n)
                        at += len(numbers)
                    drawn.sort()
                    out = [(row["_s"], k, row["b"], min(BLOCK, n - k * BLOCK), listed, z) for k, listed, z in _packed(drawn, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        names = ["_s", "_k", "b", "size", "listed", "z"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        parts = int(self.ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sizes = self.ranked.groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
        jobs = sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(self.replicates))))
        jobs = jobs.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
        # Few and short rows, each of them many draws: spread them by a fixed number of partitions.
        spread = jobs.repartition(max(parts, 64), "_s", "b", "low")
        return spread.mapInArrow(draw, "_s string, _k long, b int, size int, listed boolean, z binary")

    def rows(self) -> DataFrame:
        """``b, person, m``: one row per replicate and drawn person."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    counts = _unpacked(row["listed"], row["size"], row["z"])
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["_s"]] * len(at), pa.string()), pa.array(at + row["_k"] * BLOCK, pa.int64()),
                         pa.array(np.full(len(at), row["b"]), pa.int32()), pa.array(counts[at], pa.int64())],
                        ["_s", "_r", "b", "m"],
                    )

        drawn = self.draws().mapInArrow(unpack, "_s string, _r long, b int, m long")
        if (self.ranked.agg(F.max("_r")).first()[0] or 0) >= CHUNK:
            drawn = drawn.groupBy("_s", "_r", "b").agg(F.sum("m").alias("m"))
        # A job of a few bytes makes all these rows, so their estimated size says nothing and would have them broadcast.
        return null_safe_join(drawn.hint("merge"), self.ranked.select(self.person, "_s", "_r"), ["_s", "_r"]).select("b", self.person, "m")

    def _by_block(self, columns: dict[str, Column], function, schema: str) -> DataFrame:
        """``function(persons, counts)`` for every block of ranks; persons come in the order of the counts."""
        replicates = self.replicates

        def both(persons: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
            persons = persons.sort_values("_r", kind="mergesort")
            return function(persons, _counts(packed, len(persons), replicates))

        block = F.floor(F.col("_r") / BLOCK).alias("_k")
        persons = self.ranked.select("_s", block, "_r", *[c.alias(n) for n, c in columns.items()])
        return persons.groupBy("_s", "_k").cogroup(self.draws().groupBy("_s", "_k")).applyInPandas(both, schema)

    def sums(self, values: dict[str, Column]) -> DataFrame:
        """``b`` and the sum of each value over the drawn persons, as often as they were drawn; NULL adds nothing."""
        names = list(values)

        def add(persons: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
            table = persons[names].to_numpy("f8")
            total = np.concatenate([counts[i : i + STEP].astype("f8") @ table for i in range(0, len(counts), STEP)])
            return pd.DataFrame({"b": np.arange(1, len(counts) + 1, dtype="i4")} | {n: total[:, i] for i, n in enumerate(names)})

        parts = self._by_block(
            {n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in values.items()}, add, "b int, " + ", ".join(f"`{n}` double" for n in names)
        )
        return parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names])

    def aurocs(self, label: str, figures: dict[str, tuple[str, str | None]]) -> DataFrame:
        """``b`` and the AUROC of each figure, given as its score and its weight; NULL if a class was lost.

        Figures of one score share their counts.
        """
        scores = list(dict.fromkeys(s for s, _ in figures.values()))
        weights = list(dict.fromkeys(w for _, w in figures.values()))
        placed = self.ranked
        for i, s in enumerate(scores):
            placed = global_positions(placed.withColumn(f"_x{i}", F.col(s).cast("double")), [], [f"_x{i}", self.person], f"_p{i}")
        own = Resamples.__new__(Resamples)
        own.__dict__ = {**self.__dict__, "ranked": placed}
        columns = {"positive": F.coalesce(F.col(label) == 1, F.lit(False))}
        columns |= {f"x{i}": F.col(f"_x{i}") for i in range(len(scores))} | {f"q{i}": F.floor(F.col(f"_p{i}") / BLOCK) for i in range(len(scores))}
        one = lambda w: F.lit(1.0) if w is None else F.coalesce(F.col(w).cast("double"), F.lit(0.0))
        columns |= {f"w{j}": one(w) for j, w in enumerate(weights)}
        # A NULL score is in no ranking; NaN, the highest score, is told from it by a flag.
        columns |= {f"has{i}": F.col(f"_x{i}").isNotNull() for i in range(len(scores))}
        kinds = len(weights)

        def deal(persons: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
            out = []
            marks = persons["positive"].to_numpy(bool)
            loads = [persons[f"w{j}"].to_numpy("f8") for j in range(kinds)]
            for i in range(len(scores)):
                values, blocks = persons[f"x{i}"].to_numpy("f8"), persons[f"q{i}"].to_numpy("i8")
                there = np.flatnonzero(persons[f"has{i}"].to_numpy(bool))
                there = there[np.argsort(blocks[there], kind="stable")]
                for at in np.split(there, np.flatnonzero(np.diff(blocks[there])) + 1) if len(there) else []:
                    load = np.concatenate([w[at] for w in loads]).astype("<f8").tobytes()
                    packed = zlib.compress(np.ascontiguousarray(counts[:, at]).tobytes(), 1)
                    out.append((i, blocks[at[0]], values[at].astype("<f8").tobytes(), marks[at].tobytes(), load, packed))
            return pd.DataFrame(out, columns=["f", "q", "x", "y", "w", "m"])

        dealt = own._by_block(columns, deal, "f int, q long, x binary, y binary, w binary, m binary")
        replicates = self.replicates

        def win(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            values = np.concatenate([np.frombuffer(x, "<f8") for x in group["x"]])
            marks = np.concatenate([np.frombuffer(y, bool) for y in group["y"]])
            loads = np.concatenate([np.frombuffer(w, "<f8").reshape(kinds, -1) for w in group["w"]], axis=1)
            counts = []
            for x, m in zip(group["x"], group["m"]):
                raw, width = zlib.decompress(m), len(x) // 8
                counts.append(np.frombuffer(raw, "u1" if len(raw) == width * replicates else "<u4").reshape(replicates, width))
            counts = np.concatenate(counts, axis=1)
            order = np.argsort(values, kind="stable")
            values, marks, loads, counts = values[order], marks[order], loads[:, order], counts[:, order]
            same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            out = []
            for low in range(0, replicates, STEP):
                drawn = counts[low : low + STEP].astype("f8")
                b = np.arange(low + 1, low + 1 + len(drawn), dtype="i4")
                for j in range(kinds):
                    wp = np.add.reduceat(drawn * (loads[j] * marks), starts, axis=1)
                    wn = np.add.reduceat(drawn * (loads[j] * ~marks), starts, axis=1)
                    for end in {0, len(starts) - 1}:
                        out.append(pd.DataFrame({"b": b, "j": j, "low": values[starts[end]], "single": True, "wp": wp[:, end], "wn": wn[:, end], "won": 0.0}))
                    if len(starts) > 2:
                        wp, wn = wp[:, 1:-1], wn[:, 1:-1]
                        won = (wp * (np.cumsum(wn, axis=1) - wn / 2)).sum(axis=1)
                        out.append(pd.DataFrame({"b": b, "j": j, "low": values[starts[1]], "single": False, "wp": wp.sum(axis=1), "wn": wn.sum(axis=1), "won": won}))
            found = pd.concat(out)
            found.insert(0, "f", key[0])
            return found

        schema = "f int, b int, j int, low double, single boolean, wp double, wn double, won double"
        keys = ["f", "j", "b"]
        segments = dealt.groupBy("f", "q").applyInPandas(win, schema).groupBy(*keys, "low").agg(
            F.max("single").alias("single"), F.sum("wp").alias("wp"), F.sum("wn").alias("wn"), F.sum("won").alias("won")
        )
        # A few rows for each replicate and block of scores.
        earlier = Window.partitionBy(*keys).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        won = F.when(F.col("single"), F.col("wp") * F.col("wn") / 2).otherwise(F.col("won"))
        ranked = segments.withColumn("won", won + F.col("wp") * F.coalesce(F.sum("wn").over(earlier), F.lit(0.0)))
        pairs = F.sum("wp") * F.sum("wn")
        areas = ranked.groupBy(*keys).agg(F.when(pairs > 0, F.sum("won") / pairs).alias("area"))
        pick = lambda s, w: F.max(F.when((F.col("f") == scores.index(s)) & (F.col("j") == weights.index(w)), F.col("area")))
        return areas.groupBy("b").agg(*[pick(s, w).alias(n) for n, (s, w) in figures.items()])
