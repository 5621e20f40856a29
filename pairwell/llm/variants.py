"""Spelling variants grouped with k-d trees over letter-count vectors.

Two words that differ by one inserted, deleted or replaced letter have letter counts with an L1 distance of at most
one or two. So, for each length, the words are points, and the near words of a word are found by range searches: with
radius 2 among the words of its length and with radius 1 among those one letter longer.

1. Words are counted with partial sums before any shuffle.
2. Top trees. For each length a k-d tree is built from a sample of at most about ``SAMPLE_WORDS`` words, drawn by hash;
   its leaves are cells that cover the whole space, so every word has a cell. Cells are counted over all words, and one
   with more than ``CELL_BYTES`` is dealt over several parts.
3. Searches. A word goes to its cell and, as a query, to the cells whose box is within the radius; of two cells of one
   length the earlier one asks. In a cell a k-d tree is built over its words, boxes beyond the radius are pruned, and
   what is left in a leaf is measured, first by letter counts, then by letter order.
4. What a word learns in a cell is summed up there: its number of near words and the best of them. These are added up
   over the cells, and forms are followed to their roots by pointer jumping.

A letter's count is kept exactly for a-z and in ``FOLDED`` common sums for other letters, which only lowers distances,
so no near word is lost; letter order decides in any case. A word has at most some 180 near words for each letter, so no form
is shared by a large part of many words.

Defined cases: NULL and empty texts have no words; a NULL id counts as the empty string; long texts are read whole and
long words compared whole; repeated rows count as often as they occur; an empty table gives no rows; other columns
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.session import durable

LEAST_LETTERS, LEAST_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
#: The top trees are built from so many words; each word's place and all searches are exact.
SAMPLE_WORDS = 1 << 17
#: Words of a cell that the top trees aim at, bytes of words in a part of a cell, points in a leaf of its own tree.
CELL_WORDS = 4096
CELL_BYTES = 4_000_000
LEAF = 24
FOLDED = 6
DIMENSIONS = 26 + FOLDED
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vectors_of(words: list[bytes]) -> np.ndarray:
    """Letter counts of words in Latin-1."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    letter = np.where(data < 128, data - 97, 26 + data % FOLDED)
    return np.bincount(owner * DIMENSIONS + letter, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


class Tree:
    """A k-d tree over points. ``low`` and ``high`` are the boxes of the nodes, ``below`` the children or None, ``rows``
    the points of a leaf and ``leaf`` its number. ``whole``: boxes cover the space; otherwise they are as small as the points allow."""

    def __init__(self, points: np.ndarray, leaf: int, whole: bool):
        self.low, self.high, self.below, self.rows, self.leaf = [], [], [], [], []
        self.leaves = 0
        far = np.iinfo(np.int32).max // 4
        stack = [(np.arange(len(points)), np.full(DIMENSIONS, -far, np.int32), np.full(DIMENSIONS, far, np.int32), -1, 0)]
        while stack:
            rows, low, high, parent, side = stack.pop()
            node = len(self.below)
            if parent >= 0:
                self.below[parent][side] = node
            mine = points[rows]
            if len(rows) and not whole:
                low, high = mine.min(0), mine.max(0)
            self.low.append(low)
            self.high.append(high)
            cut = split_of(mine) if len(rows) > leaf else None
            if cut is None:
                self.below.append(None)
                self.rows.append(rows)
                self.leaf.append(self.leaves)
                self.leaves += 1
                continue
            self.below.append([0, 0])
            self.rows.append(None)
            self.leaf.append(-1)
            dim, value = cut
            left = mine[:, dim] <= value
            up, down = high.copy(), low.copy()
            up[dim], down[dim] = value, value + 1
            # The left side is taken from the stack first, so leaves are numbered from left to right.
            stack.append((rows[~left], down, high, node, 1))
            stack.append((rows[left], low, up, node, 0))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf node, queries) whose box is within the radius."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, who = stack.pop()
            mine = queries[who]
            off = np.maximum(self.low[node] - mine, 0) + np.maximum(mine - self.high[node], 0)
            who = who[off.sum(1) <= radius]
            if not len(who):
                continue
            if self.below[node] is None:
                yield node, who
            else:
                stack += [(child, who) for child in self.below[node]]


def split_of(points: np.ndarray) -> tuple[int, int] | None:
    """Dimension of the largest spread and where to cut it next to its median, if the points differ."""
    dim = int(np.argmax(points.var(0)))
    values = np.sort(points[:, dim])
    if values[0] == values[-1]:
        return None
    middle = values[len(values) // 2]
    lower, upper = values[0] <= middle - 1, middle < values[-1]
    left, through = np.searchsorted(values, middle), np.searchsorted(values, middle, side="right")
    # Below or above the median value, whichever cuts more evenly.
    if lower and (not upper or abs(2 * left - len(values)) <= abs(2 * through - len(values))):
        return dim, int(values[left - 1])
    return dim, int(middle)


@dataclass
class Cells:
    """Top trees by length, and the number of parts of large cells."""

    trees: dict[int, Tree]
    parts: dict[tuple[int, int], int]

    def homes(self, length: int, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        if length in self.trees:
            tree = self.trees[length]
            for node, who in tree.search(points, 0):
                out[who] = tree.leaf[node]
        return out

    def near(self, length: int, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, points) within the radius; lengths that the sample lacks have one cell."""
        if length not in self.trees:
            yield 0, np.arange(len(points))
            return
        tree = self.trees[length]
        for node, who in tree.search(points, radius):
            yield tree.leaf[node], who


def by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes, letter counts) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, vectors_of([words[i] for i in at])


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        for length, at, points in by_length(words):
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(at), pa.int32()), pa.array([p.astype("<i4").tobytes() for p in points], pa.binary())], names=["length", "counts"])


def counted_homes(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for length, _, points in by_length(words):
                leaves, counts = np.unique(cells.homes(length, points), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(leaves), pa.int32()), pa.array(leaves.astype(np.int32)), pa.array(counts)], names=["length", "cell", "words"])

    return run


#: ``kind``: 0 a word of the cell, 1 a query of the same length, 2 a query that is one letter shorter.
DEALT = "length int, cell int, part int, kind int, word string, n long"


def dealt(cells: Cells):
    """Words in their cells and as queries in the cells within the radius."""
    names = [c.split()[0] for c in DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            hashes = batch.column(2).to_numpy()
            for length, at, points in by_length(words):
                rows: list[tuple[int, int, int, int, np.ndarray]] = []

                def send(size: int, cell: int, kind: int, who: np.ndarray, beyond: np.ndarray | None = None) -> None:
                    parts = cells.parts.get((size, cell), 1)
                    if kind == 0:
                        own = hashes[at[who]] % parts
                        for part in np.unique(own).tolist():
                            rows.append((size, cell, part, kind, who[own == part]))
                        return
                    for part in range(parts):
                        mine = who if beyond is None else who[beyond < part]
                        if len(mine):
                            rows.append((size, cell, part, kind, mine))

                home = cells.homes(length, points)
                for cell in np.unique(home).tolist():
                    who = np.flatnonzero(home == cell)
                    send(length, cell, 0, who)
                    parts = cells.parts.get((length, cell), 1)
                    if parts > 1:
                        send(length, cell, 1, who, hashes[at[who]] % parts)
                for cell, who in cells.near(length, points, 2):
                    earlier = who[home[who] < cell]
                    if len(earlier):
                        send(length, cell, 1, earlier)
                for cell, who in cells.near(length + 1, points, 1):
                    send(length + 1, cell, 2, who)
                for size, cell, part, kind, who in rows:
                    take = pa.array(at[who])
                    fixed = [pa.array(np.full(len(who), v, np.int32)) for v in (size, cell, part, kind)]
                    yield pa.RecordBatch.from_arrays([*fixed, batch.column(0).take(take), batch.column(1).take(take)], names=names)

    return run


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one replaced, or by one more letter in ``longer``."""
    length = shorter.shape[1]
    if longer.shape[1] == length:
        return (shorter != longer).sum(1) == 1
    front, back = shorter == longer[:, :length], shorter == longer[:, 1:]
    same_front = np.where(front.all(1), length, np.argmin(front, axis=1))
    same_back = np.where(back.all(1), length, np.argmin(back[:, ::-1], axis=1))
    return same_front + same_back >= length


FOUND = "word string, n_near long, best struct<n:long,word:string>"


class Cell:
    """The words of a part of a cell, with their tree."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.points = vectors_of(words)
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        self.tree = Tree(self.points, LEAF, False)

    def pairs(self, queries: list[bytes], radius: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) indexes of near words; ``own``: the queries are the words, and each pair comes once."""
        points = self.points if own else vectors_of(queries)
        letters = self.letters if own else np.frombuffer(b"".join(queries), np.uint8).reshape(len(queries), -1)
        step = max(1, 4_000_000 // (self.letters.shape[1] + 4 * LEAF * DIMENSIONS))
        for node, who in self.tree.search(points, radius):
            rows = self.tree.rows[node]
            for low in range(0, len(who), step):
                some = who[low : low + step]
                for first in range(0, len(rows), LEAF):  # equal points make a leaf larger
                    group = rows[first : first + LEAF]
                    off = np.abs(points[some][:, None, :] - self.points[group][None, :, :]).sum(2)
                    a, b = np.nonzero(off <= radius)
                    a, b = some[a], group[b]
                    if own:
                        a, b = a[a < b], b[a < b]
                    for at in range(0, len(a), step):
                        x, y = a[at : at + step], b[at : at + step]
                        ok = one_edit(letters[x], self.letters[y])
                        yield x[ok], y[ok]


def partial(words: list[bytes], other: list[bytes], counts: np.ndarray, who: np.ndarray, whom: np.ndarray) -> pa.RecordBatch:
    """For each word of ``who``: its number of partners ``whom`` and the best one: the largest count, then the smallest word."""
    partners, place = np.unique(whom, return_inverse=True)
    order = sorted(range(len(partners)), key=lambda i: (-int(counts[partners[i]]), other[partners[i]]))
    rank = np.empty(len(partners), np.int64)
    rank[order] = np.arange(len(partners))
    owners, at, number = np.unique(who, return_inverse=True, return_counts=True)
    best = np.full(len(owners), len(partners), np.int64)
    np.minimum.at(best, at, rank[place])
    chosen = partners[np.array(order, np.int64)[best]] if len(owners) else partners
    text = lambda values, index: pa.array([values[i].decode("latin-1") for i in index.tolist()], pa.string())
    struct = pa.StructArray.from_arrays([pa.array(counts[chosen].astype(np.int64)), text(other, chosen)], names=["n", "word"])
    return pa.RecordBatch.from_arrays([text(words, owners), pa.array(number.astype(np.int64)), struct], names=["word", "n_near", "best"])


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial results (FOUND) from rows sorted by cell, part and kind: the words of a cell are held, queries pass by."""
    key, words, counts, cell = None, [], [], None

    def told(queries: list[bytes], sizes: np.ndarray, radius: int, own: bool) -> Iterator[pa.RecordBatch]:
        pairs = list(cell.pairs(queries, radius, own))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if own:
                yield partial(cell.words, cell.words, cell.counts, np.concatenate([a, b]), np.concatenate([b, a]))
            else:
                yield partial(queries, cell.words, cell.counts, a, b)
                yield partial(cell.words, queries, sizes, b, a)

    def planted() -> Iterator[pa.RecordBatch]:
        """The tree of the words gathered, and the pairs among them."""
        nonlocal cell
        if cell is None and words:
            cell = Cell(words, np.array(counts, np.int64))
            yield from told(cell.words, cell.counts, 2, True)

    for batch in batches:
        length, leaf, part, kind = (batch.column(i).to_numpy() for i in range(4))
        edges = np.flatnonzero((length[1:] != length[:-1]) | (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
        bounds = [0, *edges.tolist(), batch.num_rows] if batch.num_rows else [0]
        for low, high in zip(bounds, bounds[1:], strict=False):
            now = (int(length[low]), int(leaf[low]), int(part[low]))
            if now != key:
                yield from planted()
                key, words, counts, cell = now, [], [], None
            some = [w.encode("latin-1") for w in batch.column(4).slice(low, high - low).to_pylist()]
            sizes = batch.column(5).slice(low, high - low).to_numpy()
            if kind[low] == 0:
                words += some
                counts += sizes.tolist()
                continue
            yield from planted()
            if cell is not None:
                yield from told(some, sizes, 2 if kind[low] == 1 else 1, False)
    yield from planted()


def words_of(docs: DataFrame) -> DataFrame:
    """``word, n``: runs of letters, lower-cased in A-Z and damaged by hash, that are long and occur often enough."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # A run is the longest possible, so the shorter ones need not be cut out.
    runs = F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    gone = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2))
    word = F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def cells_of(words: DataFrame) -> Cells:
    """The top trees, from a sample of bounded size, and the sizes of all cells, from all words."""
    total = words.count()
    if not total:
        return Cells({}, {})
    share = min(1.0, SAMPLE_WORDS / total)
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word")
    rows = drawn.mapInArrow(sampled, "length int, counts binary").toPandas()
    leaf = max(1, int(CELL_WORDS * share))
    trees = {
        int(length): Tree(np.frombuffer(b"".join(found["counts"]), "<i4").reshape(-1, DIMENSIONS), leaf, True)
        for length, found in rows.groupby("length")
        if len(found) > leaf
    }
    cells = Cells(trees, {})
    counts = words.select("word").mapInArrow(counted_homes(cells), "length int, cell int, words long")
    # Only cells that have to be dealt; there are not more cells than sampled words and lengths.
    sizes = counts.groupBy("length", "cell").agg(F.sum("words").alias("words")).where(F.col("words") * (F.col("length") + 32) > CELL_BYTES)
    cells.parts = {(r["length"], r["cell"]): -(-r["words"] * (r["length"] + 32) // CELL_BYTES) for r in sizes.collect()}
    return cells


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` for every word with near words; ``best`` has the largest n, then comes first."""
    cells = cells_of(words)
    rows = words.select("word", "n", F.pmod(F.xxhash64("word", F.lit(5)), F.lit(1 << 40)).alias("h")).mapInArrow(dealt(cells), DEALT)
    placed = rows.repartition("length", "cell", "part").sortWithinPartitions("length", "cell", "part", "kind")
    found = placed.mapInArrow(searched, FOUND)
    # The smallest of (-n, word) has the largest n.
    best = F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word"))
    summed = found.select("word", "n_near", best.alias("best")).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: each round looks up the root of the root. A form is TIMES as frequent, so chains are short."""
    roots = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = durable(roots.join(up, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word."""
    words = durable(words_of(docs))
    near = words.join(near_words(words), "word", "left")
    better = F.col("best.n") >= TIMES * F.col("n")
    named = durable(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, F.col("best.n")).alias("form_n"))
    )
    return named.join(roots_of(named.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
