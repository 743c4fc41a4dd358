"""Token trees against counting whole texts anew."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acervo.llm import token_trees
from acervo.llm.queries import byte_vocabulary
from acervo.llm.token_trees import TokenTree, apply_edits, count_trees, counter, cut

COUNT = counter(byte_vocabulary())
ALPHABET = st.one_of(st.sampled_from(" ab'1.\n\ts"), st.characters(codec="utf-8"))


def check(tree, text):
    assert tree.total == COUNT(text)
    width = len(tree.sizes) // 2
    for heap in (tree.sizes, tree.tokens):
        assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, width))
    assert tree.sizes[1] == len(text)


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 20), st.text(ALPHABET, max_size=60)), max_size=6))
def test_edits_count_as_a_fresh_text(text, edits):
    old = token_trees.LEAF_CHARS
    token_trees.cut.__defaults__ = (6,)
    token_trees.LEAF_CHARS = 6
    try:
        tree = TokenTree.of_text(text, COUNT)
        check(tree, text)
        for start, length, new in edits:
            start = min(start, len(text))
            stop = min(len(text), start + length)
            want = text[:start] + new + text[stop:]
            text, _ = tree.edit(text, start, stop, new, COUNT)
            assert text == want
            check(tree, text)
    finally:
        token_trees.cut.__defaults__ = (old,)
        token_trees.LEAF_CHARS = old


def test_only_what_an_edit_touches_is_encoded():
    rng = random.Random(1)
    text = " ".join(f"word{rng.randrange(999)}" for _ in range(20_000))
    tree = TokenTree.of_text(text, COUNT)
    new, encoded = tree.edit(text, 70_000, 70_010, "some other text", COUNT)
    assert encoded < 4 * token_trees.LEAF_CHARS
    check(tree, new)
    grown, _ = tree.edit(new, 500, 500, " more text" * 2000, COUNT)
    check(tree, grown)


def test_leaves_are_the_text():
    for text in ("", "a", "x" * 5000, "a b " * 900, "é ñ\n" * 700):
        assert sum(cut(text)) == len(text)


def test_whole_table(spark, sf):
    from acervo.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_token_trees"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        text, edits = texts[r.doc_id], token_trees.cleaning_edits(texts[r.doc_id])
        assert (r.n_tokens, r.n_edits) == (COUNT(text), len(edits))
        for start, stop, new in reversed(edits):
            text = text[:start] + new + text[stop:]
        assert r.n_tokens_after == COUNT(text)
    assert sum(r.n_edits for r in got) > 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two"), (3, "x y " * 30_000)]
    docs = spark.createDataFrame([(k, t, 3, "z") for k, t in rows], "doc_id long, text string, n_tokens int, sizes string")
    trees = count_trees(docs, byte_vocabulary())
    assert sorted(r.n_tokens for r in trees.collect()) == sorted(COUNT(t or "") for _, t in rows)
    assert count_trees(docs.limit(0), byte_vocabulary()).count() == 0
    edits = spark.createDataFrame([(3, 4, 7, "new"), (3, 10**6, 10**6 + 5, "end"), (9, 0, 1, "none")], "doc_id long, start int, stop int, text string")
    done = {r.doc_id: r for r in apply_edits(token_trees.with_edits(trees.where("doc_id in (1, 3)"), edits), byte_vocabulary()).collect()}
    want = rows[4][1][:4] + "new" + rows[4][1][7:] + "end"
    assert done[3].text == want and done[3].n_tokens == COUNT(want) and done[3].n_edits == 2
    assert done[1].text == "" and done[1].n_tokens == 0


@pytest.mark.parametrize("text", ["a@b.cc x", "12345678901", "q\nq\nq"])
def test_cleaning(text):
    assert token_trees.cleaning_edits(text)
