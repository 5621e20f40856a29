"""Removal of repeated 50-byte strings with Burrows-Wheeler intervals, over any number of documents.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Anchors. Of the ``GRAM``-byte strings inside each 50-byte string the one with the smallest hash is its anchor, so
   equal strings have equal anchors. The bytes around an anchor that any 50-byte string with it can reach are a
   segment. Equal segments of a task are settled there: all but those of the smallest document go.
2. Segments. What is left moves once, packed by columns and dealt out by anchor. Of equal segments those of the
   smallest document stay; a hot anchor comes at most once from a chunk and document. Segments whose anchor has no
   other segment are done.
3. Intervals. Segments that share an anchor but differ are cut from the texts and meet in blocks of bounded size. A block's Burrows-Wheeler
   transform is extended backwards, breadth first: every round derives the boundaries of one more common prefix
   value, up to ``length - 1``. What is not bounded by then shares ``length`` bytes, and the smallest id in it counts.
   An anchor with more segments than ``BLOCK_SEGMENTS`` is dealt over several blocks, so no anchor is too frequent for
   one task. Its strings are settled where they are found; only those of a block's smallest document move on, packed by
   columns and dealt out by their 128-bit hash.
4. The spans found go back to the documents. Texts are compressed before they are moved.

Defined cases: NULL and empty texts have no bytes; texts under 50 bytes are kept whole; a document with a NULL id
neither loses nor takes anything; rows with equal ids take nothing from each other; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import Written, buckets_for, chunks, run_hashes

LENGTH = 50
GRAM = 24
#: Bytes of a segment on either side of its anchor, and strings in it.
REACH = LENGTH - GRAM
STRINGS = REACH + 1
BLOCK_SEGMENTS = 10_000
BLOCK_BYTES = 1_000_000
#: So many segments are sorted together in a task before they are sent, and so many bytes of texts hashed at once;
#: both only bound a task's memory.
HELD = 250_000
AT_ONCE = 500_000
#: A span is one number: its start times this, plus its length.
SPAN = 1 << 31


def sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over all runs of n values, by doubling."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = pick(out[:-step], out[step:]) if step else out
        width += step
    return out


def anchors_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """(text, place, hash, segment start, segment end) of the anchors of the texts ``data[begin:end]``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none, none
    at = np.arange(len(data) - GRAM + 1)
    grams = run_hashes(data, at, at + GRAM) | np.uint64(1)
    owner = np.repeat(np.arange(len(begins)), ends - begins)
    least = sliding(grams, STRINGS, np.minimum)
    # Strings that cross texts choose no anchor; 0 is no hash.
    least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0
    around = np.zeros(len(least) + 2 * REACH, np.uint64)
    around[REACH : REACH + len(least)] = least
    place = np.flatnonzero(sliding(around, STRINGS, np.maximum) == grams)
    text = owner[place]
    return text, place, grams[place], np.maximum(place - REACH, begins[text]), np.minimum(place + GRAM + REACH, ends[text])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, lowest bytes of all numbers first, which compresses well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).reshape(-1)


def steps_of(values: np.ndarray) -> np.ndarray:
    """Differences to the number before, modulo 2^64."""
    values = values.view(np.uint64)
    return np.diff(values, prepend=np.uint64(0))


#: Bytes of each packed column, and whether differences are packed.
SEGMENTS = ((6, False), (6, False), (8, True), (8, True), (8, True), (1, False))
STRINGS_OF = ((8, False), (8, False), (8, True), (8, True), (8, True))


def packed(anchor, seg, doc, kind, pos, size) -> bytes:
    """Segments in one value: anchors and segments by 48 bits of their hashes, the rest as differences in the order of the documents."""
    order = np.lexsort((pos, kind, doc))
    parts = [planes(anchor[order], 6), planes(seg[order] >> 16, 6)]
    parts += [planes(steps_of(c[order]), 8) for c in (doc, kind, pos)] + [planes(size[order], 1)]
    return b"".join(parts)


def packed_strings(one, two, doc, kind, pos) -> bytes:
    """Strings in one value: both halves of their hashes, the rest as differences in the order of the documents."""
    order = np.lexsort((pos, kind, doc))
    return b"".join([planes(one[order], 8), planes(two[order], 8)] + [planes(steps_of(c[order]), 8) for c in (doc, kind, pos)])


def unpacked(raw: bytes, columns: tuple[tuple[int, bool], ...] = SEGMENTS) -> list[np.ndarray]:
    n = len(raw) // sum(width for width, _ in columns)
    out, at = [], 0
    for width, steps in columns:
        values = unplanes(raw[at : at + width * n], width)
        out.append((np.cumsum(values, dtype=np.uint64) if steps else values).view(np.int64))
        at += width * n
    return out


def merged(doc: np.ndarray, kind: np.ndarray, pos: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """(doc, kind, span) of the unions of spans that touch in a text."""
    order = np.lexsort((pos, kind, doc))
    doc, kind, pos, stop = doc[order], kind[order], pos[order], (pos + size)[order]
    # Segments have at most 2 * LENGTH bytes, and the order of their starts is that of their ends.
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1]) | (pos[1:] > stop[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return [doc[first], kind[first], pos[first] * SPAN + stop[last] - pos[first]]


def changes(*keys: np.ndarray) -> np.ndarray:
    """Whether any of the keys differs from the one before, from the second row on."""
    return np.logical_or.reduce([k[1:] != k[:-1] for k in keys])


def smallest_of(keys: tuple[np.ndarray, ...], doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each row has the smallest document of its key; ``order`` brings keys together, documents ascending."""
    doc = doc[order]
    first = np.flatnonzero(np.concatenate([[True], changes(*(k[order] for k in keys))]))
    least = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
    out = np.empty(len(doc), dtype=bool)
    out[order] = doc == least
    return out


ENTRIES = "bucket int, entries binary, doc long, kind long, span long"


def located(buckets: int):
    """Packed segments by bucket of their anchor, and spans that the texts of a task settle, from (doc, kind, text)."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, seg, doc, kind, pos, size = (np.concatenate(c) for c in zip(*held, strict=True))
        # Two anchors with one segment hash may split a group; what is not settled here is settled later.
        stays = smallest_of((seg, anchor), doc, np.lexsort((doc, seg)))
        gone = ~stays
        if gone.any():
            spans = merged(doc[gone], kind[gone], pos[gone], size[gone])
            m = len(spans[0])
            # The spans go along with any bucket.
            yield pa.RecordBatch.from_arrays([pa.array((np.arange(m) % buckets).astype(np.int32)), pa.nulls(m, pa.binary()), *map(pa.array, spans)], names=names)
        columns = [c[stays] for c in (anchor, seg, doc, kind, pos, size)]
        bucket = (columns[0].astype(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        columns, bucket = [c[order] for c in columns], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        stop = np.append(first[1:], len(bucket))
        blobs = [packed(*(c[f:t] for c in columns)) for f, t in zip(first.tolist(), stop.tolist(), strict=True)]
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blobs, pa.binary()), none, none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            ids, kinds = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for low, high in chunks([len(t) for t in texts], AT_ONCE):
                data, begins, ends = joined(texts[low:high])
                text, _, grams, start, end = anchors_of(data, begins, ends)
                if not len(text):
                    continue
                seg = run_hashes(data, start, end) ^ grams
                held.append([(grams >> np.uint64(16)).view(np.int64), seg.view(np.int64), ids[low:high][text], kinds[low:high][text], start - begins[text], end - start])
                count += len(text)
                if count >= HELD:
                    yield from flush(held)
                    held, count = [], 0
        if held:
            yield from flush(held)

    return run


SETTLED = "doc long, kind long, span long, anchor long, part int, dealt boolean"


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove (anchor NULL), and segments whose anchor has other segments, from entries sorted by bucket."""
    names = [c.split()[0] for c in SETTLED.split(", ")]

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        anchor, seg, doc, kind, pos, size = (np.concatenate(c) for c in zip(*map(unpacked, blobs), strict=True))
        order = np.lexsort((doc, seg, anchor))
        stays = smallest_of((anchor, seg), doc, order)
        gone = ~stays
        if gone.any():
            spans = merged(doc[gone], kind[gone], pos[gone], size[gone])
            m = len(spans[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, spans), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_())], names=names)
        order = order[stays[order]]
        a, d = anchor[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], changes(a)]))
        rows = np.diff(np.append(first, len(a)))
        # Equal segments are of one document by now, and the segments of one document take nothing from each other.
        several = np.repeat(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first), rows)
        parts = np.repeat(-(-rows // BLOCK_SEGMENTS), rows)[several]
        at = order[several]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(kind[at]), pa.array(pos[at] * SPAN + size[at]), pa.array(anchor[at]), pa.array((seg[at] % parts).astype(np.int32)), pa.array(parts > 1)], names=names
        )

    held: list[bytes] = []
    current = None
    for batch in batches:
        own = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if own.any():
            spans = batch.filter(pa.array(own))
            m = spans.num_rows
            yield pa.RecordBatch.from_arrays([*spans.columns[2:], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_())], names=names)
        rest = batch.filter(pa.array(~own))
        for bucket, blob in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist(), strict=True):
            if held and bucket != current:
                yield from solve(held)
                held = []
            current = bucket
            held.append(blob)
    if held:
        yield from solve(held)


CUT = "anchor long, part int, dealt boolean, doc long, kind long, pos long, bytes binary"


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted segments of each text, from (doc, kind, text, wanted)."""
    names = [c.split()[0] for c in CUT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        for doc, kind, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = unpack.decompress(text)
            for w in wanted:
                pos, size = divmod(w["span"], SPAN)
                rows.append((w["anchor"], w["part"], w["dealt"], doc, kind, pos, raw[pos : pos + size]))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def rotations(data: np.ndarray) -> np.ndarray:
    """Start of each rotation of ``data`` in the order of their first 64 bytes at least."""
    n = len(data)
    around = np.resize(data, n + 7)
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(around, 8)).view(">u8").reshape(-1).astype(np.uint64)
    order, width = np.argsort(key), 8
    # So many ranks fit into one number.
    joint = 3 if n < 1 << 21 else 2
    while width < 64:
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        key = rank
        for i in range(1, joint):
            key = key * n + np.roll(rank, -i * width)
        order, width = np.argsort(key), joint * width
    return order


def boundaries(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where, in the order of rotations, the common prefix with the one before is shorter than ``length``.

    Breadth-first backward extension: round v holds the intervals of strings of v bytes whose end was found in it,
    extends each to the left by every byte that stands before it, and marks the ends of the new intervals.
    """
    n = len(data)
    before = data[order - 1]
    source = np.argsort(before, kind="stable")
    letter = before[source]
    lf = np.empty(n, np.int64)
    lf[source] = np.arange(n)
    within = np.empty(n, np.int64)
    bound = np.zeros(n + 1, dtype=bool)
    bound[0] = bound[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        # All rows of the intervals; where they lead, rows of one interval and byte are neighbours.
        width = high - low
        if not len(width):
            break
        which = np.repeat(np.arange(len(width)), width)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + low[which]
        within[rows] = which
        led = np.zeros(n, dtype=bool)
        led[lf[rows]] = True
        to = np.flatnonzero(led)
        first = np.flatnonzero(np.concatenate([[True], changes(within[source[to]], letter[to])]))
        new_low = to[first]
        new_high = to[np.append(first[1:], len(to)) - 1] + 1
        # The interval that ends at the end of the order is also new in every round.
        fresh = ~bound[new_high] | (new_high == n)
        low, high = new_low[fresh], new_high[fresh]
        bound[high] = True
    return bound[:n]


def block_masks(segments: list[bytes], docs: np.ndarray):
    """For all strings of the segments: (segment, offset, smallest document of the block that has the string)."""
    data, begins, ends = joined(segments)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = rotations(data)
    group = np.cumsum(boundaries(data, order, LENGTH)) - 1
    owner = np.repeat(np.arange(len(begins)), ends - begins)
    whole = np.arange(len(data)) + LENGTH <= ends[owner]
    held = np.where(whole, docs[owner], np.iinfo(np.int64).max)[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(held, starts)
    smallest = np.empty(len(data), np.int64)
    smallest[order] = least[group]
    at = np.flatnonzero(whole)
    return owner[at], at - begins[owner[at]], smallest[at]


def found_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of strings that a smaller document has; for anchors dealt over several blocks all strings with their smallest document.

    The rows are sorted by anchor and part; a block ends between anchors, or inside one that is alone too large because
    its rows were dealt unevenly. A batch is of spans or of strings.
    """
    names = ["doc", "kind", "span", "string", "least"]

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, kinds, starts = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        dealt = np.array([r[2] for r in rows])
        owner, offset, least = block_masks([r[6] for r in rows], docs)
        at = starts[owner] + offset
        done = np.flatnonzero((least < docs[owner]) & ~dealt[owner])
        if len(done):
            own = owner[done]
            spans = merged(docs[own], kinds[own], at[done], np.full(len(done), LENGTH, np.int64))
            m = len(spans[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, spans), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=names)
        rest = np.flatnonzero(dealt[owner])
        if len(rest):
            own, off = owner[rest], offset[rest]
            strings = [hashlib.blake2b(rows[o][6][f : f + LENGTH], digest_size=16).digest() for o, f in zip(own.tolist(), off.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[own]), pa.array(kinds[own]), pa.array(at[rest] * SPAN + LENGTH), pa.array(strings, pa.binary()), pa.array(least[rest])], names=names
            )

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            # A part of a dealt anchor may be cut anywhere, as its strings are merged below.
            if rows and size >= BLOCK_BYTES and (row[:2] != rows[-1][:2] or row[2]):
                yield from solve(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[6])
    if rows:
        yield from solve(rows)


DEALT = "doc long, kind long, span long, bucket int, strings binary"


def settled_in_task(buckets: int):
    """Of what ``found_in_blocks`` tells, the spans, and by bucket the strings that no smaller document in sight has.

    A string with a smaller document goes where it is found; that document's string stands for it elsewhere.
    """
    names = [c.split()[0] for c in DEALT.split(", ")]

    def of_spans(spans: list) -> pa.RecordBatch:
        m = len(spans[0])
        return pa.RecordBatch.from_arrays([*spans, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        one, two, doc, kind, pos, least = (np.concatenate(c) for c in zip(*held, strict=True))
        gone = (least < doc) | ~smallest_of((one, two), doc, np.lexsort((doc, two, one)))
        if gone.any():
            yield of_spans([pa.array(c) for c in merged(doc[gone], kind[gone], pos[gone], np.full(int(gone.sum()), LENGTH, np.int64))])
        columns = [c[~gone] for c in (one, two, doc, kind, pos)]
        bucket = (columns[0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        columns, bucket = [c[order] for c in columns], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        stop = np.append(first[1:], len(bucket))
        blobs = [packed_strings(*(c[f:t] for c in columns)) for f, t in zip(first.tolist(), stop.tolist(), strict=True)]
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(bucket[first]), pa.array(blobs, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in found_in_blocks(batches):
            if batch.column(3).null_count:
                yield of_spans(batch.columns[:3])
                continue
            halves = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, 2)
            doc, kind, span, least = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            held.append([halves[:, 0], halves[:, 1], doc, kind, span // SPAN, least])
            count += len(doc)
            if count >= HELD:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    return run


def settled_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of strings that a smaller document has, from (bucket, strings) sorted by bucket."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        one, two, doc, kind, pos = (np.concatenate(c) for c in zip(*(unpacked(b, STRINGS_OF) for b in blobs), strict=True))
        gone = ~smallest_of((one, two), doc, np.lexsort((doc, two, one)))
        if gone.any():
            spans = merged(doc[gone], kind[gone], pos[gone], np.full(int(gone.sum()), LENGTH, np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, spans)], names=["doc", "kind", "span"])

    held: list[bytes] = []
    current = None
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and bucket != current:
                yield from solve(held)
                held = []
            current = bucket
            held.append(blob)
    if held:
        yield from solve(held)


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6, write_checksum=False)
    for batch in batches:
        texts = pa.array([pack.compress(t) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "kind", "text"])


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc, kind, span``: what goes; ``texts`` are the compressed texts of ``docs``."""
    buckets = buckets_for(docs)
    entries = docs.where("doc_id is not null").mapInArrow(located(buckets), ENTRIES)
    first = Written(entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settled, SETTLED), "segments").df
    lists = first.where("anchor is not null").groupBy(F.col("doc").alias("doc_id"), "kind").agg(F.collect_list(F.struct("anchor", "part", "dealt", "span")).alias("wanted"))
    cut = texts.join(lists, ["doc_id", "kind"]).select("doc_id", "kind", "text", "wanted").mapInArrow(cut_segments, CUT)
    blocks = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = Written(blocks.mapInArrow(settled_in_task(buckets), DEALT), "strings").df
    dealt = found.where("strings is not null").select("bucket", "strings").repartition("bucket").sortWithinPartitions("bucket")
    spans = first.where("anchor is null").select("doc", "kind", "span").unionByName(found.where("strings is null").select("doc", "kind", "span"))
    return spans.unionByName(dealt.mapInArrow(settled_strings, "doc long, kind long, span long"))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) from (doc_id, compressed text, spans)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = unpack.decompress(text.as_py())
            left, gone, runs = raw, 0, 0
            if spans.is_valid:
                codes = spans.values.to_numpy()
                begin, size = codes // SPAN, codes % SPAN
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + size, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                runs = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
                left = np.frombuffer(raw, np.uint8)[~covered].tobytes()
            out.append((len(raw), gone, runs, hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def kind_of(docs: DataFrame) -> Column:
    """Tells rows of one id apart by their texts; 0 in tables without such rows, where it costs nothing to move."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return F.lit(0).cast("long") if again.isEmpty() else F.xxhash64("text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every document; ``kept`` is what is left, as bytes."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    plain = plain.select("doc_id", kind_of(plain).alias("kind"), "text")
    texts = plain.mapInArrow(compressed, "doc_id long, kind long, text binary")
    spans = repeated_spans(plain, texts).groupBy(F.col("doc").alias("doc_id"), "kind").agg(F.collect_list("span").alias("spans"))
    both = texts.join(spans, ["doc_id", "kind"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
