"""Byte-level encoding by distinct words against the library, which only the tests run."""

import hashlib
import struct

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from acervo.llm import byte_words
from acervo.llm.queries import QUERIES, byte_vocabulary

RANKS = byte_words.read_ranks(byte_vocabulary())
LIB = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst'éñ12."), st.characters(codec="utf-8")), min_size=1, max_size=120))
def test_words_merge_as_in_the_library(text):
    import regex

    for word in regex.findall(PATTERN, text):
        assert byte_words.merge_word(word.encode(), RANKS) == LIB.encode_ordinary(word)
        assert byte_words._merge_long(word.encode(), RANKS) == LIB.encode_ordinary(word)


@pytest.mark.parametrize("word", ["a" * 3000, "xyz" * 700, "é" * 400, "the" * 500, "-" * 999, "abcabcab" * 60])
def test_long_words(word):
    assert byte_words.merge_word(word.encode(), RANKS) == LIB.encode_ordinary(word)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_packed_numbers(numbers):
    packed = byte_words.pack_numbers(np.array(numbers, np.int64))
    assert byte_words.unpack_numbers(packed).tolist() == numbers


def expected(doc_id, text):
    ids = LIB.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(LIB.decode_bytes(ids)).hexdigest()


def test_whole_table(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["op11_byte_words"](spark, sf).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def words_of(row):
    lengths, body = byte_words.unpack_parts(bytes(row.words))
    return [body[end - n : end] for n, end in zip(lengths, np.cumsum(lengths))]


def test_many_blocks_give_the_same(spark):
    rows = [(i, f"word{i % 7} and {'same ' * (i % 5)}end's\n\n x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    exploded = byte_words.explode_words(docs, PATTERN, "text", ("doc_id",), 5).collect()
    blocks = {r.block for r in exploded}
    assert len(blocks) == 7
    for block in blocks:
        mine = [r for r in exploded if r.block == block]
        words = [w for r in mine if r.words is not None for w in words_of(r)]
        assert len(words) == len(set(words))
        assert sum(r.order is not None for r in mine) == 1
    got = byte_words.encode_texts(docs, byte_vocabulary()).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: LIB.encode_ordinary(t) for i, t in rows}


def test_blocks_end_where_they_are_full(spark):
    rows = [(i, f"w{i} " + "filler text " * 60_000) for i in range(40)]  # 28 MB in one partition
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    exploded = byte_words.explode_words(docs, PATTERN, "text", ("doc_id",), 3)
    assert exploded.select("block").distinct().count() > 1
    got = byte_words.encode_texts(docs, byte_vocabulary()).collect()
    assert all(len(r.ids) == 4 * len(LIB.encode_ordinary(rows[r.doc_id][1])) for r in got) and len(got) == 40


def test_each_distinct_word_is_encoded_once(spark):
    body = [b"the", b" of", b"zzzzqq"]
    packed = bytearray(byte_words.pack_parts(np.array([3, 3, 6]), b"".join(body)))
    words = spark.createDataFrame([(b, k, packed) for b in range(40) for k in (0, 1)], "block long, bucket int, words binary")
    got = byte_words.encode_words(words, byte_vocabulary()).collect()
    assert len(got) == 80 and len({bytes(r.ids) for r in got}) == 1
    counts, ids = byte_words.unpack_parts(bytes(got[0].ids))
    ids = byte_words.unpack_numbers(ids)
    assert [ids[end - n : end].tolist() for n, end in zip(counts, np.cumsum(counts))] == [LIB.encode_ordinary(w.decode()) for w in body]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x y", "c"), (2, "same", "d"), (2, "same", "d"), (3, "ab " * 200_000, "e"), (4, "<|endoftext|>", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = byte_words.encode_texts(docs, byte_vocabulary())
    assert encoded.columns == ["doc_id", "ids"]
    decoded = byte_words.decode_ids(encoded, byte_words.token_bytes(spark, byte_vocabulary()))
    got = sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in decoded.collect())
    want = sorted((i or 0, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t, _ in rows for x in [LIB.encode_ordinary(t or "")])
    assert got == want
    assert byte_words.encode_texts(docs.limit(0), byte_vocabulary()).count() == 0
    nothing = byte_words.encode_texts(docs.where("doc_id = 1"), byte_vocabulary())
    assert [bytes(r.ids) for r in nothing.collect()] == [b"", b""]


def test_decoding_any_ids(spark):
    rows = [(1, bytearray(struct.pack("<3I", 220, 50255, 0))), (2, None), (3, bytearray())]
    got = byte_words.decode_ids(spark.createDataFrame(rows, "doc_id int, ids binary"), byte_words.token_bytes(spark, byte_vocabulary()))
    found = {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in got.collect()}
    assert found == {1: LIB.decode_bytes([220, 50255, 0]), 2: None, 3: b""}
    short = byte_words.token_bytes(spark, byte_vocabulary()).where("id < 5")
    with pytest.raises(Exception):  # noqa: B017
        byte_words.decode_ids(spark.createDataFrame(rows, "doc_id int, ids binary"), short).collect()
