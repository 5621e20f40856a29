"""SentencePiece encoding with the place of every piece in the original text, and decoding.

The library finds the pieces. Which bytes of the text a piece stands for is told by the normalisation, done here once
more with a record of where each byte comes from: at every place the longest prefix that the model's compiled
character map knows is replaced, and the bytes of the replacement are aligned with the start of that prefix. Spaces
become the space mark, a leading mark is added and white space is trimmed as the model says. The pieces of a text,
joined, are its normalised text; that they are as long is checked for every text. Their ends in it, looked up in the
alignment, are the byte spans.

A character that the model spells in bytes has its span at its last byte; the bytes before have empty spans.

Defined cases: NULL and empty texts have no pieces; long texts are encoded whole, and a batch ends after ``CHUNK``
bytes of text; malformed UTF-8 counts as U+FFFD, one for each byte; rows with equal or NULL ids and repeated rows are
rows of their own; an empty table gives no rows; other columns than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import chunks

MARK = "▁".encode()
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


class CharacterMap:
    """A compiled character map: the size of a double array, the array, and the replacements, each ended by a zero.

    A unit of the array holds the offset of its children, the label that leads to it, and whether a value follows.
    """

    def __init__(self, compiled: bytes, kept: tuple[bytes, ...] = ()):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :] if compiled else b""
        self.kept = sorted(kept, key=len, reverse=True)
        self.plain = not self.units and not self.kept

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest known prefix of ``text[at:]`` and the length of that prefix."""
        for word in self.kept:
            if text.startswith(word, at):
                return word, len(word)
        best, length = -1, 0
        if self.units:
            node = self.offset(self.units[0])
            for i in range(at, len(text)):
                node ^= text[i]
                unit = self.units[node]
                if unit & 0x800000FF != text[i]:
                    break
                node ^= self.offset(unit)
                if unit >> 8 & 1:
                    best, length = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if length:
            return self.texts[best : self.texts.index(b"\0", best)], length
        width = character(text, at)
        return (text[at : at + width], width) if width else ("�".encode(), 1)


def character(text: bytes, at: int) -> int:
    """Length of the UTF-8 character at a place, 0 if it is malformed."""
    lead = text[at]
    width = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    try:
        return len(text[at : at + width].decode().encode())
    except UnicodeDecodeError:
        return 0


class Normaliser:
    """Normalised text with, for each of its bytes and its end, the place in the original that it comes from."""

    def __init__(self, compiled: bytes, prefix: bool, trim: bool, escape: bool, suffix: bool = False, kept: tuple[bytes, ...] = ()):
        self.map = CharacterMap(compiled, kept)
        self.prefix, self.trim, self.suffix = prefix, trim, suffix
        self.space = MARK if escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if self.map.plain and not self.trim:
            try:
                text.decode()
                return self.unchanged(text)
            except UnicodeDecodeError:
                pass
        return self.mapped(text)

    def unchanged(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Nothing but spaces is replaced."""
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return b"", np.zeros(1, np.int32)
        start = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data), dtype=np.int32), 0))
        places = np.repeat(start, np.where(data == 0x20, len(self.space), 1))
        front = np.zeros(len(self.space) if self.prefix and not self.suffix else 0, np.int32)
        back = np.full(1 + (len(self.space) if self.prefix and self.suffix else 0), len(data), np.int32)
        out = text.replace(b" ", self.space)
        out = self.space + out if len(front) else out + self.space if len(back) > 1 else out
        return out, np.concatenate([front, places, back])

    def mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        found: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            new, length = self.map.longest(text, at)
            found.append((new, at))
            at += length
        i = 0
        if self.trim:
            while i < len(found) and found[i][0] == b" ":
                i += 1
        if i == len(found):
            return b"", np.zeros(1, np.int32)
        out, places = bytearray(), []

        def add(piece: bytes, place: int) -> None:
            out.extend(piece)
            places.extend([place] * len(piece))

        if self.prefix and not self.suffix:
            add(self.space, found[i][1])
        after_space = self.trim
        for new, place in found[i:]:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                add(new.replace(b" ", self.space), place)
                after_space = self.trim and new.endswith(b" ")
        end = len(text)
        while self.trim and out.endswith(self.space):
            end = places[len(out) - len(self.space)]
            del out[-len(self.space) :], places[-len(self.space) :]
        if self.prefix and self.suffix:
            add(self.space, end)
        return bytes(out), np.array([*places, end], np.int32)


class Model:
    """A model file: the library's processor, its normaliser, and the bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.processor.serialized_model_proto())
        told = proto.normalizer_spec
        kept = tuple(p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED)
        self.normalise = Normaliser(
            told.precompiled_charsmap, told.add_dummy_prefix, told.remove_extra_whitespaces, told.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix, kept
        )
        self.pieces = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.encode() for p in proto.pieces]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.unknown, self.bytes_known = self.processor.unk_id(), proto.trainer_spec.byte_fallback

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text: its pieces and their byte spans in it."""
        for text, ids in zip(texts, self.processor.encode(texts, num_threads=1, return_type="numpy") if texts else [], strict=True):
            ids = np.asarray(ids, np.int32)
            yield ids, *self.spans(text, ids)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        normal, places = self.normalise(text)
        lengths = self.lengths[ids]
        if not self.bytes_known and (ids == self.unknown).any():
            # An unknown piece stands for the characters themselves.
            lengths = np.array([self.lengths[i] if i != self.unknown else len(s.encode()) for i, s in zip(ids, self.processor.encode(text, out_type=str), strict=True)])
        ends = np.cumsum(lengths)
        if len(normal) != (ends[-1] if len(ends) else 0):
            raise ValueError("the pieces are not as long as the normalised text")
        return places[ends - lengths], places[ends]


@cache
def model(path: str) -> Model:
    """One for each Python worker."""
    return Model(path)


def lists_of(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, starts, ends`` (ENCODED): the pieces of every text and their byte spans. ``path`` names the model on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for low, high in chunks([len(t) for t in texts]):
                found = list(m.encode_all(texts[low:high]))
                columns = [lists_of([f[i] for f in found]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the text of each list of ids, as the library gives it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = model(path).processor
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))])
            for low, high in chunks((4 * np.diff(bounds)).tolist()):
                texts = [processor.decode(ids[a:b]) if a < b else "" for a, b in zip(bounds[low:high], bounds[low + 1 : high + 1], strict=True)]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from the lists of ids and the texts decoded from them."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
