"""Searching by signatures against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from acervo.llm import bit_search

TERM = re.compile(bit_search.TERM)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text). All scores, by the definition."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, doc if doc is not None else -1))
        out += [(item, rank, None if doc == -1 else doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    index = bit_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted((tuple(r) for r in bit_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def test_terms():
    text = "Ab-1 ÉCOLE_x\x00y\x7fz 日本、é  \tA" + "".join(map(chr, range(128)))
    assert [t.decode() for t in bit_search.terms(text.encode())] == plain_terms(text)


def test_bounds_never_lie_below_scores():
    rng = random.Random(3)
    vocabulary = [f"t{i}".encode() for i in range(300)]
    docs = [Counter(rng.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=rng.choice([1, 5, 60, 900]))) for _ in range(70)]
    lengths = np.array([sum(c.values()) for c in docs])
    most = np.array([max(c.values()) for c in docs])
    hashed = {t: xxhash.xxh3_64_intdigest(t) for t in vocabulary}
    entries = []
    for c in docs:
        tf = np.array(list(c.values()))
        levels = bit_search.levels_of(tf)
        entries.append((int(levels.sum()), np.array([hashed[t] for t in c], np.uint64), levels))
    width, slices = bit_search._block(entries)
    asked_terms = vocabulary[::3] + [b"absent"]
    parts = [np.array(rng.sample(range(len(asked_terms)), 12)) for _ in range(9)]
    weights = np.array([rng.randrange(1, 9000) for _ in asked_terms])
    asked = bit_search.Queries(list(range(9)), {t: i for i, t in enumerate(asked_terms)}, weights, parts, len(docs), int(lengths.sum()))
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in asked_terms], np.uint64)
    upper = bit_search.bounds(asked, hashes, lengths, most, width, slices)
    shift = asked.shift(lengths)
    for q, part in enumerate(parts):
        for d, c in enumerate(docs):
            exact = sum(int(weights[p]) * (10**9 * c[asked_terms[p]] // (1000 * c[asked_terms[p]] + int(shift[d]))) for p in part if c[asked_terms[p]])
            assert exact <= upper[q, d]
    assert (upper == 0).any()


def test_levels():
    assert bit_search.levels_of(np.array([1, 2, 3, 4, 7, 8, 1 << 40])).tolist() == [1, 2, 2, 3, 3, 4, bit_search.LEVELS]


def test_blocks_of_long_documents_are_smaller():
    few = list(bit_search._runs([10] * 1500))
    assert few == [(0, 512), (512, 1024), (1024, 1536)]
    long = list(bit_search._runs([3_000_000] * 20))
    assert [b - a for a, b in long] == [8, 8, 8]


def test_same_as_scoring_everything(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 9, 80, 700])))) for i in range(1500)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 15, 60])))) for i in range(40)]
    docs += [(5000 + i, items[7][1] + " shared tail") for i in range(60)]  # ties beyond the list's length
    assert found(spark, docs, items) == brute(docs, items)


def test_items_in_groups(spark, monkeypatch):
    monkeypatch.setattr(bit_search, "ITEM_TERMS", 4)
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(200)]
    items = [(i, f"a{i % 3} b1 c{i}") for i in range(12)]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_rescoring_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(bit_search, "BROADCAST_IDS", 1)
    docs = [(i, f"a{i % 3} b{i % 5} c{i}") for i in range(200)]
    items = [(i, f"a{i % 3} b1 c{i}") for i in range(5)]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,;"), (None, "alpha beta"), (4, "Alpha alpha"), (4, "Alpha alpha"), (5, "beta " * 60_000), (6, "alpha"), (7, "gamma")]
    items = [(1, "alpha, BETA"), (1, "gamma"), (2, None), (3, "unknown"), (4, ""), (5, "ALPHA alpha")]
    assert found(spark, docs, items) == brute(docs, items)
    extra = spark.createDataFrame([(1, "alpha", 3, 4)], "doc_id long, text string, score int, item int")
    asked = spark.createDataFrame([(9, "alpha zeta", 1)], "item_id int, text string, rank int")
    out = bit_search.search(bit_search.build_index(extra), asked)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.item_id, r.rank, r.doc_id) for r in out.collect()] == [(9, 1, 1)]


def test_empty_tables(spark):
    assert found(spark, [(1, "a")], [(1, "b")]) == []
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bit_search.search(bit_search.build_index(none), items).count() == 0
    index = bit_search.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert bit_search.search(index, items.limit(0)).count() == 0


def test_same_as_the_sql_over_whole_tables(spark, sf):
    from acervo.llm.queries import QUERIES, SQL
    from oracle_check import compare, duck

    ok, note = compare(spark, duck(sf), sf, QUERIES["op12_bit_search"], SQL["op12_bit_search"])
    assert ok, note
