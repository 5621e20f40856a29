"""Exact Jaccard join of documents on sets of word 5-grams, with set relations used to skip work.

Equal sets are one node. Every node's shingles are put into one global order, frequent ones last, and its prefix is
indexed: nodes with a similarity of at least ``PERCENT`` share a shingle of their prefixes. Then

1. Leaders. In every list of the index the nodes of similar size point to one of them, and each node is compared
   with the node it meets most often. Links found here join nodes to components; nodes inside a component need no
   further comparison. This is repeated while it finds links, each time in linear work. A large group of copies may
   be joined by few of its pairs; its members are then dealt over hashed cells of the lists, new ones each round,
   and a node outside is compared with heads of these cells, as long as that finds enough links.
2. Block skipping. What is left are pairs of nodes in different components. Index lists are cut into blocks by size
   and position. A node probes the directory of blocks first and skips every block in which no pair can reach the
   overlap, given the positions; only the others are read.
3. Derived answers. The symmetric difference is a metric, so the comparison of two leaders bounds those of their
   followers: most pairs follow from their leaders' computed distance, and only undecided ones are compared.

Before shingles of a pair are moved, the bits of both are: a few bits for each shingle, set by its hash. Places in
which they differ are at most as many as shingles in one set only, so too many of them rule a link out.

Shingles and sets are told apart by 64-bit hashes; two sets with one hash are detected by a second hash, and the
job starts again with another seed.

Defined cases: NULL and empty texts have empty sets and no links; fewer than five words are one shingle; equal rows
and copies share a component; a NULL id never names a component unless all its members have NULL ids; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.llm.common import PLAIN, SMALL, Words, Written, chunks, few, join_facts, mixed, run_hashes
from pairwell.llm.components import components, durable_few
from pairwell.session import durable

PERCENT = 80
SHINGLE = 5
#: So many of the most frequent shingles at most get a rank of their own in the order (9 bytes each, broadcast).
RANKED = 1 << 17
#: A shingle counts towards the ranks from so many different sets in one task on.
REPEATED = 3
#: Lists of ranked shingles above this share of all lists' rows are dealt over SALTS tasks.
SALTS = 64
#: Components of so many nodes are dealt over cells; partners of a node in a round; compared pairs per link from which
#: on the rest is left to the exact search. They divide the work; no link depends on them.
LARGE = 32
CELLS = 16
PARTNERS = 32
PAIRS_PER_LINK = 100
#: A head is dealt out from so many pairs on.
PAIRS_OF_HEAD = 5_000
#: Pairs with what both nodes have that are together in a partition, and nodes whose partners are.
PAIRS_TOGETHER = 1 << 11
NODES_TOGETHER = 1 << 10
#: 2^19 words of 64 bits say which nodes are needed: a fixed size; errors only send more.
BITMAP_WORDS = 1 << 19
#: Bytes of text that a task is handed, and hashes, at once; index entries and bytes of shingles that leave a task at
#: once; bytes of a row group of shingles; shingles that a task counts at once.
BATCH_BYTES = "2m"
TEXT_BYTES = 200_000
ENTRIES = 50_000
ARRAY_BYTES = 2_000_000
GROUP_BYTES = 8_000_000
COUNTED = 1 << 22
#: Bits of a node: the power of two from so many for each shingle on, in whole words, up to MOST_BITS. Fewer rule out less.
BITS_PER_SHINGLE = 4
MOST_BITS = 1 << 20


def shingle_sets(texts: list[bytes], seed: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(index, sorted distinct shingle hashes, hash of the set, second hash of the set) for each text."""
    for low, high in chunks([len(t) for t in texts], TEXT_BYTES):
        words = Words(texts[low:high], PLAIN)
        at, hashes = words.windows(SHINGLE)
        cut = np.searchsorted(at, words.first)
        counts = np.diff(words.first)
        for i in range(high - low):
            if counts[i] >= SHINGLE:
                found = np.unique(hashes[cut[i] : cut[i + 1]])
            elif counts[i]:
                found = run_hashes(words.hashes, words.first[i : i + 1], words.first[i + 1 : i + 2])
            else:
                found = np.zeros(0, np.uint64)
            one = int(np.add.reduce(mixed(found + np.uint64(seed)), dtype=np.uint64))
            two = int(np.bitwise_xor.reduce(mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)) if len(found) else 0
            yield low + i, found, one, two


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand their tasks few bytes of text at once: a task holds a batch in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def batch_of(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _counts(every: np.ndarray) -> pa.RecordBatch | None:
    """Shingles that are there ``REPEATED`` times; ``every`` is sorted in place."""
    every.sort()
    last = REPEATED - 1
    often = np.unique(every[last:][every[last:] == every[: len(every) - last]])
    if not len(often):
        return None
    counts = np.searchsorted(every, often, "right") - np.searchsorted(every, often, "left")
    none = pa.nulls(len(often), pa.int64())
    return batch_of(["doc_id", "n", "node", "check", "token", "sets"], none, none, none, none, signed(often), pa.array(counts, pa.int64()))


def sketched(seed: int, keyed: bool = False):
    """Rows of two kinds: (doc_id, n, node, check) for documents and (token, sets) for shingles that repeat in a task.

    ``keyed``: a third column of the input is passed on as ``sha``.
    """

    def counted(every: np.ndarray) -> pa.RecordBatch | None:
        rows = _counts(every)
        return batch_of([*rows.schema.names, "sha"], *rows.columns, pa.nulls(rows.num_rows, pa.binary())) if keyed and rows is not None else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        gathered, size = np.empty(COUNTED, np.uint64), 0
        for batch in batches:
            n, node, check = [], [], []
            for _, found, one, two in shingle_sets(bytes_of(batch, 1), seed):
                n.append(len(found))
                node.append(one)
                check.append(two)
                if not len(found) or one in seen:
                    continue
                seen.add(one)
                if size + len(found) > len(gathered):
                    if (rows := counted(gathered[:size])) is not None:
                        yield rows
                    gathered, size = gathered if len(found) <= len(gathered) else np.empty(len(found), np.uint64), 0
                gathered[size : size + len(found)] = found
                size += len(found)
            none = pa.nulls(len(n), pa.int64())
            names, more = ["doc_id", "n", "node", "check", "token", "sets"], ()
            if keyed:
                names, more = [*names, "sha"], (batch.column(2),)
            yield batch_of(names, batch.column(0), pa.array(n, pa.int64()), signed(node), signed(check), none, none, *more)
        if (rows := counted(gathered[:size])) is not None:
            yield rows

    return run


def levels_of(found: np.ndarray, ranked: np.ndarray, levels: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rank classes of shingles: 0 for those that are not ranked."""
    out = np.zeros(len(found), np.uint8)
    maybe = np.flatnonzero(bits[found >> np.uint64(44)])
    if len(maybe):
        at = np.minimum(np.searchsorted(ranked, found[maybe]), len(ranked) - 1)
        hit = ranked[at] == found[maybe]
        out[maybe[hit]] = levels[at[hit]]
    return out


def prefix_length(n: int) -> int:
    return n - (n * PERCENT + 99) // 100 + 1


def postings_of(seed: int, ranked: np.ndarray, levels: np.ndarray, salted: int):
    """Index entries (token, part, node, n, pos) of the prefixes; ``part`` deals out the lists of hot shingles."""
    bits = np.zeros(1 << 20, dtype=bool)
    bits[ranked >> np.uint64(44)] = True

    def packed(tokens, owners, sizes, places, dealt) -> pa.RecordBatch:
        return batch_of(
            ["token", "part", "node", "n", "pos"],
            signed(np.concatenate(tokens)), pa.array(np.concatenate(dealt)), signed(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        columns, held = ([], [], [], [], []), 0
        for batch in batches:
            for _, found, node, _ in shingle_sets(bytes_of(batch, 0), seed):
                if not len(found) or node in seen:
                    continue
                seen.add(node)
                level = levels_of(found, ranked, levels, bits) if len(ranked) else np.zeros(len(found), np.uint8)
                order = np.argsort(level, kind="stable")[: prefix_length(len(found))]
                entries = (
                    found[order], np.full(len(order), node, np.uint64), np.full(len(order), len(found), np.int32),
                    np.arange(len(order), dtype=np.int32), np.where(level[order] >= salted, 1 + node % SALTS, 0).astype(np.int32),
                )
                for column, values in zip(columns, entries, strict=True):
                    column.append(values)
                held += len(order)
                if held >= ENTRIES:
                    yield packed(*columns)
                    columns, held = ([], [], [], [], []), 0
        if held:
            yield packed(*columns)

    return run


def shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by token, n and node: those with another node of similar size next to them in their list.

    Sizes are sorted, so a node without a similar size beside it has none in the list. Entries of hot lists, of
    which a task sees a part, all stay.
    """
    held: pa.RecordBatch | None = None
    told = 0  # so many rows of ``held`` are out already and only stand beside what follows

    def kept(rows: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
        """What stays of the rows from ``start`` to ``stop``."""
        token, part, node, n, _ = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(token):
            return rows
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        one = np.flatnonzero(first)
        token, part, node, n = token[one], part[one], node[one], n[one].astype(np.int64)
        near = np.zeros(len(token) + 1, dtype=bool)
        near[1:-1] = (token[1:] == token[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
        stay = one[near[1:] | near[:-1] | (part > 0)]
        return rows.take(pa.array(stay[(stay >= start) & (stay < stop)]))

    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = rows.column(0).to_numpy()
        last = int(np.flatnonzero(token != token[-1])[-1]) + 1 if len(token) and token[0] != token[-1] else 0
        # The last list may go on in the next batch; of one that outgrows a batch, the last two rows are kept back.
        if last == 0 and len(token) > 200_000:
            yield kept(rows, told, len(token) - 1)
            held, told = rows.slice(len(token) - 2), 1
            continue
        held = rows.slice(last)
        if last:
            yield kept(rows.slice(0, last), told, last)
            told = 0
    if held is not None:
        yield kept(held, told, held.num_rows)


def bits_of(found: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them, with the bits set that the low ends of the hashes name."""
    size = min(MOST_BITS, max(64, 1 << (BITS_PER_SHINGLE * len(found) - 1).bit_length()))
    flags = np.zeros(size, dtype=bool)
    flags[(found & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def places_apart(left: np.ndarray, right: np.ndarray) -> int:
    """In how many bits both differ; the longer one is folded first."""
    size = min(len(left), len(right))
    left, right = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x for x in (left, right))
    return int(np.bitwise_count(left ^ right).sum())


def arrays_of(seed: int, words: np.ndarray):
    """(node, n, bits, shingles) of the nodes whose bit is set, each once in a task."""

    def packed(nodes, sizes, bits, values) -> pa.RecordBatch:
        return batch_of(["node", "n", "bits", "shingles"], signed(nodes), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(values, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        columns, held = ([], [], [], []), 0
        for batch in batches:
            for _, found, node, _ in shingle_sets(bytes_of(batch, 0), seed):
                bit = node >> 39
                if len(found) and node not in seen and int(words[bit >> 6]) >> (bit & 63) & 1:
                    seen.add(node)
                    for column, value in zip(columns, (node, len(found), bits_of(found).tobytes(), found.tobytes()), strict=True):
                        column.append(value)
                    held += found.nbytes
                    if held >= ARRAY_BYTES:
                        yield packed(*columns)
                        columns, held = ([], [], [], []), 0
        if held:
            yield packed(*columns)

    return run


def in_common(left: np.ndarray, right: np.ndarray) -> int:
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum())


def measured(measure, name: str):
    """(a, b, n_a, n_b) and a measure of the words that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [measure(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch_of(["a", "b", "n_a", "n_b", name], *(batch.column(i) for i in range(4)), pa.array(values, pa.int64()))

    return run


def linked(n_a: Column, n_b: Column, common: Column) -> Column:
    return (common > 0) & (100 * common >= PERCENT * (n_a + n_b - common))


def apart(n_a: Column, n_b: Column, difference: Column) -> Column:
    """Whether sets with at least this symmetric difference have no link."""
    return (100 + PERCENT) * difference > (100 - PERCENT) * (n_a + n_b)


def whole_hash() -> Column:
    """SHA-256 of the whole text."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("sha")


class Join:
    """One run over a table of documents. ``keyed``: rows are told apart by ``sha``, the hash of the whole text, too."""

    def __init__(self, docs: DataFrame, keyed: bool = False):
        self.docs, self.keyed = docs, keyed
        self.text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        for self.seed in range(1, 100):
            columns = [F.col("doc_id").cast("long"), self.text] + ([whole_hash()] if keyed else [])
            schema = "doc_id long, n long, node long, check long, token long, sets long" + (", sha binary" if keyed else "")
            both = docs.select(*columns).mapInArrow(sketched(self.seed, keyed), schema)
            with small_batches(docs.sparkSession):
                both = durable(both)
            self.sets = both.where("token is null").select("doc_id", "n", "node", "check", *(["sha"] if keyed else []))
            best = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("best")] if keyed else []
            nodes = self.sets.where("n > 0").groupBy("node").agg(F.min("check").alias("c"), F.max("check").alias("d"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_rows"), *best)
            self.nodes = durable(few(nodes, self.sets.count()))
            if self.nodes.where("c != d").isEmpty():
                break
        self.rank(both.where("token is not null"))

    def rank(self, repeated: DataFrame) -> None:
        """The most frequent shingles in classes by powers of two of their counts."""
        counts = repeated.groupBy("token").agg(F.sum("sets").alias("sets"))
        top = counts.orderBy(F.desc("sets"), "token").limit(RANKED)
        found = top.select("token", F.floor(F.log2("sets")).cast("int").alias("level")).toPandas()
        tokens = found["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        self.ranked, self.levels = tokens[order], found["level"].to_numpy(np.uint8)[order]
        # A list is hot with more than 1/1000 of all nodes.
        self.many = self.nodes.count()
        self.salted = max(8, int(self.many // 1000).bit_length())

    def index(self) -> DataFrame:
        """The index lists with something to compare, written once."""
        entries = self.docs.select(self.text).mapInArrow(postings_of(self.seed, self.ranked, self.levels, self.salted), "token long, part int, node long, n int, pos int")
        dealt = entries.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node")
        with small_batches(self.docs.sparkSession):
            self.lists = Written(dealt.mapInArrow(shared_lists, "token long, part int, node long, n int, pos int").select("token", "node", "n", "pos"), "index")
        size = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")
        return self.lists.df.withColumn("sb", size)

    def arrays(self, entries: DataFrame) -> Written:
        """``node, n, bits, shingles`` of the nodes in the index, where their texts are: a node comes once from a task that has it.

        They are stored by columns without a shuffle; ``meet`` moves the ones that are needed.
        """
        wanted = entries.select("node").distinct()
        bit = F.shiftrightunsigned("node", 39)
        words = wanted.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(node, 39) & 63L as int))")).alias("bits"))
        rows = words.toPandas()
        table = np.zeros(BITMAP_WORDS, np.uint64)
        table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        rows = self.docs.select(self.text).mapInArrow(arrays_of(self.seed, table), "node long, n long, bits binary, shingles binary")
        with small_batches(self.docs.sparkSession):
            return Written(rows, "arrays", compression="none", **{"parquet.block.size": GROUP_BYTES})

    def meet(self, pairs: DataFrame, column: str) -> DataFrame:
        """Pairs (a, b) with a column of both. What ``a`` has goes to ``b``, which is dealt out if many pairs ask for it.

        Up to ``SMALL`` pairs are broadcast, so that only columns of their nodes are moved; more are joined by shuffles.
        """
        pairs = durable(pairs.select("a", "b"))
        count = pairs.count()
        near = F.broadcast if count <= SMALL else lambda df: df
        pairs = few(pairs, count)
        heads = durable(few(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_OF_HEAD).cast("int").alias("parts")), count))
        asked = pairs.join(near(heads), "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
        x = self.sets_of.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("x")).join(near(asked), "a")
        y = self.sets_of.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("y")).join(near(heads), "b")
        y = y.select("b", "n_b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        # Several tasks may hold a node.
        x = x.repartition("b", "part").dropDuplicates(["b", "part", "a"])
        y = y.repartition("b", "part").dropDuplicates(["b", "part"])
        return few(x.join(y, ["b", "part"]).select("a", "b", "n_a", "n_b", "x", "y"), count, PAIRS_TOGETHER)

    def measure(self, pairs: DataFrame, column: str, how, name: str) -> DataFrame:
        with small_batches(pairs.sparkSession):
            return durable(self.meet(pairs, column).mapInArrow(measured(how, name), f"a long, b long, n_a long, n_b long, {name} long"))

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """``low``: a bound from below of the symmetric difference of pairs (a, b)."""
        return self.measure(pairs, "bits", places_apart, "low")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """Exact overlaps ``common`` of pairs (a, b)."""
        return self.measure(pairs, "shingles", in_common, "common")

    def links(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The linked ones of pairs (a, b) with their overlaps, and the number of all pairs."""
        bounded = self.bounds(pairs)
        found = self.overlaps(bounded.where(~apart(F.col("n_a"), F.col("n_b"), F.col("low"))))
        return found.where(linked(F.col("n_a"), F.col("n_b"), F.col("common"))), bounded.count()

    def run(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` for every document; if keyed, its ``sha`` and the ``best`` row of its component.

        ``best`` has the smallest id, a NULL id last, then the smallest ``sha``; it is NULL for components of one row.
        """
        entries = self.index()
        comps = None
        if not entries.isEmpty():
            arrays = self.arrays(entries)
            self.sets_of = arrays.df
            comps = components_of_all(self, entries)
            arrays.drop()
        self.lists.drop()
        facts = self.nodes.withColumn("comp", F.col("node"))
        if comps is not None:
            facts = self.nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        # One row per node; only components of several rows matter below.
        best = [F.min("best").alias("best")] if self.keyed else []
        firsts = facts.drop("best").join(facts.groupBy("comp").agg(F.min("first").alias("component"), F.sum("_rows").alias("_all"), *best).where("_all > 1"), "comp")
        named = firsts.select("node", "component", "_rows", *(["best"] if self.keyed else []))
        more = ["sha"] if self.keyed else []
        rows = self.sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"), *more)
        rows = rows.withColumn("_spread", F.xxhash64("doc_id", *more))
        joined = join_facts(rows, few(named, self.many), "node", "_spread")
        more = ["sha", "best"] if self.keyed else []
        return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *more)


def proposals(entries: DataFrame) -> DataFrame:
    """Pairs (a, b): for each node, the head of another component that it meets in most lists."""
    heads = entries.groupBy("token", "sb").agg(F.min(F.struct("comp", "node")).alias("head"))
    met = entries.join(heads, ["token", "sb"]).where(F.col("comp") != F.col("head.comp"))
    counted = met.groupBy("node", F.col("head.node").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    best = counted.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("lists", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def cell_proposals(entries: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): for each node, heads of the cells of other, large components in its lists, those met most often first."""
    large = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") >= LARGE)
    drawn = F.xxhash64("token", "node", F.lit(turn))
    members = entries.join(large, "comp", "left_semi").select("token", "sb", "comp", "node", "n", "pos", drawn.alias("drawn"))
    cells = members.groupBy("token", "sb", F.pmod("drawn", F.lit(CELLS)).alias("cell")).agg(F.min(F.struct("comp", "drawn", "node", "n", "pos")).alias("head"))
    n, pos = F.col("head.n"), F.col("head.pos")
    rest = 1 + F.least(F.col("n") - F.col("pos") - 1, n - pos - 1)
    met = entries.join(cells.drop("cell"), ["token", "sb"]).where((F.col("comp") != F.col("head.comp")) & ((100 + PERCENT) * rest >= PERCENT * (F.col("n") + n)))
    counted = met.groupBy(F.col("node").alias("a"), F.col("head.node").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    # A node has at most CELLS partners for each shingle of its prefix.
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("lists"), F.xxhash64("b", F.lit(turn))))
    return counted.withColumn("place", place).where(F.col("place") <= PARTNERS).select("a", "b")


def open_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that may be similar, found by skipping blocks of the lists."""
    split = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    rows = entries.join(split, "token", "left_semi").withColumn("pb", F.floor(F.col("pos") * 32 / F.col("n")).cast("int"))
    rows = durable(rows)
    directory = rows.groupBy("token", "sb", "pb").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("from"), F.min("comp").alias("c_low"), F.max("comp").alias("c_high")
    )
    least, whole = PERCENT, 100 + PERCENT

    def reaches(n_a, pos_a, n_low, n_high, pos_b):
        rest = 1 + F.least(n_a - pos_a - 1, n_high - pos_b - 1)
        return (whole * rest >= least * (n_a + n_low)) & (100 * n_a >= least * n_low)

    probe = rows.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"), F.col("comp").alias("c_a"), F.explode(F.array("sb", F.col("sb") + 1)).alias("sb"))
    hits = probe.join(directory, ["token", "sb"]).where(
        reaches(F.col("n_a"), F.col("p_a"), F.greatest("low", F.least("n_a", "high")), F.col("high"), F.col("from"))
        & (F.col("high") >= F.col("n_a"))
        & ((F.col("c_low") != F.col("c_a")) | (F.col("c_high") != F.col("c_a")))
    )
    hits = hits.select("token", "sb", "pb", "a", "n_a", "p_a", "c_a")
    other = rows.select("token", "sb", "pb", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("p_b"), F.col("comp").alias("c_b"))
    met = hits.join(other, ["token", "sb", "pb"]).where(
        (F.col("c_a") != F.col("c_b"))
        & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & reaches(F.col("n_a"), F.col("p_a"), F.col("n_b"), F.col("n_b"), F.col("p_b"))
    )
    return met.select("a", "b", F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b")).distinct()


def derived(join: Join, pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """The linked pairs (a, b), decided from their leaders' distance where that is enough."""
    far = lambda side: leaders.select(F.col("node").alias(side), F.col("leader").alias(f"l_{side}"), F.col("distance").alias(f"d_{side}"))
    told = pairs.join(far("a"), "a", "left").join(far("b"), "b", "left")
    told = told.select(
        "a", "b", "n_a", "n_b",
        F.coalesce("l_a", "a").alias("l_a"), F.coalesce("l_b", "b").alias("l_b"),
        (F.coalesce("d_a", F.lit(0)) + F.coalesce("d_b", F.lit(0))).alias("off"),
    )
    told = durable(told)
    count = told.count()
    told = few(told, count)
    leading = [F.col("l_a").alias("a"), F.col("l_b").alias("b")]
    bounded = join.bounds(told.select(*leading).distinct()).select(F.col("a").alias("l_a"), F.col("b").alias("l_b"), "low")
    near = durable_few(told.join(bounded, ["l_a", "l_b"]).where(~apart(F.col("n_a"), F.col("n_b"), F.col("low") - F.col("off"))).drop("low"), count)
    between = join.overlaps(near.select(*leading).distinct())
    distance = between.select(F.col("a").alias("l_a"), F.col("b").alias("l_b"), (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("d"))
    judged = near.join(distance, ["l_a", "l_b"])
    sure = F.when(~apart(F.col("n_a"), F.col("n_b"), F.col("d") + F.col("off")), F.lit(True)).when(apart(F.col("n_a"), F.col("n_b"), F.col("d") - F.col("off")), F.lit(False))
    judged = durable(few(judged.withColumn("sure", sure), count))
    direct, _ = join.links(judged.where("sure is null"))
    return judged.where("sure").select("a", "b").union(direct.select("a", "b"))


def components_of_all(join: Join, entries: DataFrame) -> DataFrame | None:
    """``node, comp`` of all nodes with links, or None."""
    edges = comps = leaders = None
    known = entries.withColumn("comp", F.col("node"))
    turn, enough, kept = 0, False, None
    while not enough:
        new, pairs = join.links(few(cell_proposals(known, comps, turn) if turn else proposals(known), join.many, NODES_TOGETHER))
        if leaders is None:
            leaders = new.select(F.col("a").alias("node"), F.col("b").alias("leader"), (F.col("n_a") + F.col("n_b") - 2 * F.col("common")).alias("distance"))
        links = new.count()
        if links:
            edges = new.select("a", "b") if edges is None else edges.union(new.select("a", "b"))
            comps = components(edges)
            near = F.broadcast(comps) if comps.count() <= SMALL else comps
            before, kept = kept, Written(entries.join(near, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "entries")
            known = kept.df
            if before is not None:
                before.drop()
        # One head for each list until that finds nothing, then cells.
        if turn:
            enough = links * PAIRS_PER_LINK < max(pairs, 1)
        else:
            enough = comps is None
        turn += int(turn > 0 or links == 0)
    last = durable(derived(join, open_pairs(known), leaders))
    if kept is not None:
        kept.drop()
    if not last.isEmpty():
        edges = last if edges is None else edges.union(last)
        comps = components(edges)
    return comps


def shingle_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document: the smallest id that links reach."""
    return Join(docs).run()


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every component, with all its columns.

    It is decided by row, told by id and whole text: an id that other rows hold does not drop them. The row with the
    smallest id stays, a NULL id comes after all others, and the smallest SHA-256 of the text decides between rows
    of one id. Rows equal in id (NULL equals NULL) and text are one document.
    """
    found = durable(Join(docs, keyed=True).run())
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("sha") == F.col("best.sha"))
    rest = found.where(F.col("best").isNotNull() & ~stays).select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_gone_sha")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), whole_hash().alias("_sha"))
    kept = whole.join(rest, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    twice = found.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        kept = kept.groupBy("_id", "_sha").agg(F.first("_row").alias("_row"))
    return kept.select("_row.*")
