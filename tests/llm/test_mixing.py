"""The schedule's bounds, and placements against a plain simulation."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acervo.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(0.001, 10), min_size=1, max_size=12))
def test_no_source_is_a_block_off(weights):
    shares = mixing.whole_shares(weights, 500)
    assert sum(shares.values()) == 500 and set(shares) == set(weights) and min(shares.values()) >= 1
    done = dict.fromkeys(shares, 0)
    for t, k in enumerate(mixing.schedule(shares), 1):
        done[k] += 1
        assert all(abs(done[s] - c * t / 500) < 1 for s, c in shares.items())
    assert done == shares


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.source, len(r.text)) for r in docs.collect()}
    rows = mixing.mix_plan(docs, block_chars=4000, period=1000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    totals = {}
    for s, n in texts.values():
        totals[s] = totals.get(s, 0) + n
    shares = mixing.whole_shares({f"={s}": n**mixing.EXPONENT for s, n in totals.items()}, 1000)
    slots, seen = {}, {}
    order = mixing.schedule(shares)
    for turn in range(3):
        for slot, k in enumerate(order):
            slots[k, seen.setdefault(k, 0)] = turn * 1000 + slot
            seen[k] += 1
    for s in totals:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (r.block, r.offset))
        at, w = 0, shares[f"={s}"] / 1000
        for r in mine:  # rows without gaps, one after another
            assert r.n_chars == texts[r.doc_id][1]
            assert (r.block, r.offset) == divmod(at, 4000)
            assert r.slot == slots[f"={s}", r.block]
            assert r.release == math.floor(r.block / w + 1e-9) and r.deadline == math.ceil((r.block + 1) / w - 1e-9)
            assert r.release <= r.slot < r.deadline
            at += r.n_chars


def test_given_weights_and_odd_rows(spark):
    rows = [(1, "abc", "a"), (1, "abc", "a"), (2, None, "b"), (None, "x" * 9, None), (3, "", "c"), (4, "y" * 100_000, "b"), (5, "z", "unweighted"), (6, "zz", None)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, source string, slot int, _name int")
    got = mixing.mix_plan(docs, {"a": 3, "b": 1, None: 2, "absent": 5}, block_chars=4, period=100)
    assert got.columns == ["doc_id", "source", "n_chars", "block", "offset", "release", "deadline", "slot"]
    out = got.collect()
    assert len(out) == len(rows)
    weighted = [r.slot for r in out if r.source in ("a", "b", None)]
    assert all(r.slot > max(weighted) and r.release is None for r in out if r.source in ("c", "unweighted"))
    assert sorted(r.n_chars for r in out) == sorted(len(t or "") for _, t, _ in rows)
    assert mixing.mix_plan(docs.limit(0)).count() == 0
    mixed = mixing.mixed_order(docs.drop("_name"), {"a": 1, "b": 1})
    assert mixed.columns == docs.drop("_name").columns and mixed.count() == len(rows)


def test_too_many_sources():
    with pytest.raises(ValueError):
        mixing.whole_shares({str(i): 1 for i in range(11)}, 10)


def test_columns_of_any_name(spark):
    names = ["_name", "_chars", "_hash", "_bucket", "_block", "_slot", "_offset", "~_name"]
    rows = [(i, "text " * 20, "a" if i % 3 else "b", *range(8)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mixed_order(docs, {"a": 1.0, "b": 1.0})
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == rows
    placed = mixing.placed(docs)
    assert set(placed.columns) == set(docs.columns) | {"_release", "_deadline"} and placed.count() == 30
    assert placed.where("_slot >= 0 and _offset >= 0 and _name = 0").count() == 30
    assert set(mixing.mixed_after(docs, lambda rows, keep: rows.select(*keep, "source")).columns) == {"doc_id", "source", "slot", "offset"}
