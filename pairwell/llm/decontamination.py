"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and characters outside ASCII. Every window of
13 consecutive words of a benchmark item is looked up; a shorter item is one window. Tasks hash the windows of each
document from running sums, look them up in the broadcast set, compare the words of each hit, and mark the words
that any true hit covers.

The set is broadcast in blocks of at most ``BLOCK_WORDS`` benchmark words, counted beforehand: an ordinary benchmark
is one block, a larger one adds passes over the documents' words, not memory.

Defined cases: NULL and empty texts have no words, nothing hits them and they hit nothing; an item may occur in many
documents and several items may share a window (each counts); repeated rows are judged alike; empty tables give no
rows or no hits; extra columns are kept and never clash, because verdicts are computed by expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import NORMAL, Words, chunks

WINDOW = 13
BLOCK_WORDS = 2_000_000
#: A document is contaminated if it has a hit word and at least one of so many words is hit.
SHARE = 20


class TestWindows:
    """Windows of one block of items, by length: sorted hashes, and for each the words and the items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[bytes, list[str]]]]] = {}
        found: dict[int, dict[bytes, set[str]]] = {}
        hashes: dict[bytes, int] = {}
        for item, text in items:
            words = Words([text], NORMAL)
            n = min(window, len(words.starts))
            if n:
                for at, h in zip(*words.windows(n), strict=True):
                    key = gram(words, at, n)
                    found.setdefault(n, {}).setdefault(key, set()).add(item)
                    hashes[key] = int(h)
        for n, grams in found.items():
            keys = sorted(grams, key=hashes.__getitem__)
            values = np.array([hashes[k] for k in keys], np.uint64)
            bits = np.zeros(1 << 22, dtype=bool)
            bits[values >> np.uint64(42)] = True
            self.lengths[n] = values, np.packbits(bits), [(k, sorted(grams[k])) for k in keys]

    def hits(self, words: Words):
        """(first word, length, items) of every occurrence, compared word by word."""
        for n, (values, packed, grams) in self.lengths.items():
            at, h = words.windows(n)
            maybe = np.flatnonzero(np.unpackbits(packed).view(bool)[h >> np.uint64(42)])
            left = np.searchsorted(values, h[maybe], "left")
            right = np.searchsorted(values, h[maybe], "right")
            for i, low, high in zip(at[maybe[left < right]], left[left < right], right[left < right], strict=True):
                key = gram(words, i, n)
                for k in range(low, high):
                    if grams[k][0] == key:
                        yield int(i), n, grams[k][1]


def gram(words: Words, at: int, n: int) -> bytes:
    return b" ".join([words.buffer[words.starts[i] : words.ends[i]] for i in range(at, at + n)])


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> list[TestWindows]:
    """The benchmark in blocks of bounded size. Texts are counted before they are fetched."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text.cast("binary").alias("text"))
    # Every second character at most begins a word.
    size = rows.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    many = int(size // block_words) + 1
    found = []
    for k in range(many):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k) if many > 1 else rows
        found.append(TestWindows(((r["item"] or "", bytes(r["text"])) for r in part.toLocalIterator()), window))
    return found


def judged(block: list[TestWindows]):
    """Arrow function: of each text, its word count, the items found, the marked runs of words, and their count."""

    def judge(texts: pa.Array) -> pa.Array:
        raw = [t or b"" for t in texts.to_pylist()]
        n_words, n_hit, items, starts, ends = [], [], [], [], []
        for low, high in chunks([len(t) for t in raw]):
            words = Words(raw[low:high], NORMAL)
            begins = np.cumsum([0, *(len(t) + 1 for t in raw[low:high])])
            marks = np.zeros(len(words.starts) + 1, np.int64)
            owner = words.text_of()
            found: list[set[str]] = [set() for _ in range(high - low)]
            for test in block:
                for at, n, names in test.hits(words):
                    marks[at] += 1
                    marks[at + n] -= 1
                    found[owner[at]].update(names)
            covered = np.cumsum(marks[:-1]) > 0
            total = np.zeros(len(covered) + 1, np.int64)
            np.cumsum(covered, out=total[1:])
            n_words += np.diff(words.first).tolist()
            n_hit += np.diff(total[words.first]).tolist()
            for i, names in enumerate(found):
                items.append(sorted(names))
                own = covered[words.first[i] : words.first[i + 1]]
                if names:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    starts.append((words.starts[words.first[i] + edges[::2]] - begins[i]).tolist())
                    ends.append((words.ends[words.first[i] + edges[1::2] - 1] - begins[i]).tolist())
                else:
                    starts.append([])
                    ends.append([])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ("n_words", "n_hit", "items", "starts", "ends")
        return pa.StructArray.from_arrays(
            [pa.array(v, k) for v, k in zip((n_words, n_hit, items, starts, ends), kinds, strict=True)], names=list(names)
        )

    return judge


KIND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,starts:array<bigint>,ends:array<bigint>>"


def verdict(benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Column:
    """The verdict on a text column as a struct: n_words, n_hit, items, and byte ranges ``starts``, ``ends`` of hits."""
    judge = F.arrow_udf(judged(blocks_of(benchmark, window, block_words)), KIND)
    return judge(F.col(text).cast("binary"))


def contaminated(found: Column, share: int = SHARE) -> Column:
    return (found["n_hit"] > 0) & (found["n_hit"] * share >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with its counts, the digest of the items and the verdict."""
    found = docs.select("doc_id", verdict(benchmark).alias("found"))
    f = F.col("found")
    return found.select(
        "doc_id",
        f["n_words"].alias("n_words"),
        f["n_hit"].alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"),
        contaminated(f).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return docs.where(~contaminated(verdict(benchmark)))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, with the marked ranges cut out of their texts."""
    blocks = blocks_of(benchmark, WINDOW, BLOCK_WORDS)
    judge = judged(blocks)

    def cut(texts: pa.Array) -> pa.Array:
        found = judge(texts).to_pylist()
        out = []
        for text, spans in zip(texts.to_pylist(), found, strict=True):
            if text is None:
                out.append(None)
                continue
            kept, at = [], 0
            for start, end in zip(spans["starts"], spans["ends"], strict=True):
                kept.append(text[at:start])
                at = end
            out.append(b"".join([*kept, text[at:]]))
        return pa.array(out, pa.binary())

    text = F.arrow_udf(cut, "binary")(F.col("text").cast("binary")).cast("string")
    return docs.withColumn("text", text)
