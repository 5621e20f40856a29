"""Pieces and their spans against the library, with and without a character map."""

import hashlib

import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwell.llm import pieces
from pairwell.llm.queries import PIECE_MODEL, QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   ", "a", " a  b ", "tab\tnew\nline\r\n", "é é ﬁ ½ ① ＡＢＣ", "漢字 かな 한국어", "😀👩‍👩‍👧 ​﻿", "▁ ▁▁x", "<s> </s> <unk> <0x41>",
    "\x00\x01\x7f", "a" * 5000, "x y " * 3000, "\U0001F1E9\U0001F1EA \U00100000", " 　 wide", "aḅ̈c",
]


@pytest.fixture(scope="module")
def own():
    return pieces.Model(PIECE_MODEL)


def spans_of_library(model, text):
    """(ids, byte spans) as the library tells them."""
    told = model.processor.encode(text, return_type="proto")
    return [p.id for p in told.pieces], [(p.begin, p.end) for p in told.pieces]


def test_spans(own):
    for text in [t for t in ODD if t]:
        ids, starts, ends = own.encode(text.encode())
        expected, spans = spans_of_library(own, text)
        assert ids.tolist() == expected
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == spans, text
        assert ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_spans_of_any_text(text):
    model = pieces.model(PIECE_MODEL)
    ids, starts, ends = model.encode(text.encode())
    expected, spans = spans_of_library(model, text) if text else ([], [])
    assert ids.tolist() == expected and list(zip(starts.tolist(), ends.tolist(), strict=True)) == spans


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
def test_character_map(rule, trim):
    """Longest prefixes of compiled maps, against the library's normaliser."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    compiled = proto.normalizer_spec.precompiled_charsmap
    assert compiled
    own = pieces.Normaliser(compiled, True, trim, True)

    @settings(max_examples=150, deadline=None)
    @given(st.text(max_size=30))
    def same(text):
        expected, offsets = library.normalize(text, with_offsets=True)
        got, places = own(text.encode())
        assert got.decode() == expected
        whole, at = got.decode(), 0
        for c, place in zip(whole, offsets, strict=False):
            # The library counts code points of the original, ours counts bytes.
            assert len(text.encode()[: places[at]].decode()) == place
            at += len(c.encode())

    same()
    for text in [t for t in ODD if t is not None]:
        assert own(text.encode())[0].decode() == library.normalize(text)


def test_malformed_bytes(own):
    for raw in (b"a\xff\xfeb", b"\xe2\x82", b"\xf0\x9f\x98 x", b"\x80", b"\xed\xa0\x80."):
        ids, starts, ends = own.encode(raw)
        assert ends[-1] == len(raw) and own.processor.decode(ids.tolist()).count("�") >= 1


def expected(rows):
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for doc, text in rows:
        ids = processor.encode(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield doc, len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids) if ids else "")


def test_test_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_pieces"](spark, FOLDER).collect())) == sorted(expected(rows))


def test_odd_rows(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)] * 2 + [(99, "long word " * 500_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, decoded string").repartition(3)
    got = pieces.digests(pieces.decode(pieces.encode(docs, PIECE_MODEL), PIECE_MODEL))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(rows), key=repr)
    assert pieces.digests(pieces.decode(pieces.encode(docs.limit(0), PIECE_MODEL), PIECE_MODEL)).count() == 0
    spans = pieces.encode(docs.where("doc_id = 99"), PIECE_MODEL).collect()[0]
    raw = rows[-1][1].encode()
    assert b"".join(raw[a:b] for a, b in zip(spans["starts"], spans["ends"], strict=True)) == raw
