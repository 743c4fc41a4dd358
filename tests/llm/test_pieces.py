"""Encoding and decoding against the library, which only the tests run."""

import hashlib
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from acervo.llm import pieces
from acervo.llm.queries import piece_model

MODEL = piece_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(text):
    packed = pieces.codec(MODEL).encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a", "  Hello  world\n\t x▁y <s> é​\x00 日本語 😀 </s> <0x41>", "\n\n", "a\nb c\r\n", "▁", "aaaaaaaaaaaaaaaaaaaa" * 9,
    " " * 77, "def f(x):\n        return x  # ok", "THEY'RE!!!! $$$###", "internationalizationalism", "étéêèç ñandú Straße", "�", "﻿x",
])
def test_same_ids_and_text(text):
    want = LIB.encode(text, add_bos=True, add_eos=True)
    assert ids_of(text) == want
    assert pieces.codec(MODEL).decode(struct.pack(f"<{len(want)}I", *want)) == LIB.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" abcdehinorst\n\t.▁0é"), st.characters(codec="utf-8")), max_size=80))
def test_same_as_library_on_any_text(text):
    assert ids_of(text) == LIB.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, LIB.vocab_size() - 1).filter(lambda i: i != 0) | st.integers(3, 258), max_size=12))
def test_same_decoding_of_any_ids(ids):
    assert pieces.codec(MODEL).decode(struct.pack(f"<{len(ids)}I", *ids)) == LIB.decode(ids)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pieces.encoding_digest(pieces.encode_texts(docs, MODEL)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        ids = LIB.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7), (3, "long " * 50_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_texts(docs, MODEL)
    assert got.columns == ["doc_id", "ids", "decoded"]
    out = got.collect()
    assert len(out) == 5
    assert {(r.doc_id, len(r.ids), r.decoded) for r in out if r.doc_id in (1, 2)} == {(1, 8, ""), (2, 8, "")}
    back = {r.text for r in pieces.decode_ids(got, MODEL).collect()}
    assert back == {"", "a b", "long " * 50_000}
    assert pieces.encode_texts(docs.limit(0), MODEL).count() == 0
