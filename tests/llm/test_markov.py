"""Scores against a plain unigram, a plain forward recursion, and sums to one."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest

from acervo.llm import markov


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts, held = {}, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, t in texts.items():
        if not held[i]:
            for w in [*words_of(t), " "]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = markov.lm_scores(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens = [*words_of(texts[r.doc_id]), " "]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(w in counts for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def small_model(seed, classes=markov.CLASSES):
    rng = np.random.default_rng(seed)
    rows = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    k = markov.STATES
    return markov.Model(rows(k), rows(k), rows(k, k), rows(k, classes))


def test_forward_is_exact():
    m = small_model(1)
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, markov.CLASSES, n) for n in (1, 4, 2, 3)]
    for c, got in zip(codes, markov.log_likelihoods(m, codes)):
        total = 0.0
        for path in itertools.product(range(markov.STATES), repeat=len(c)):
            p = m.start[path[0]] * m.emit[path[0], c[0]]
            for t in range(1, len(c)):
                p *= m.move[path[t - 1], path[t]] * m.emit[path[t], c[t]]
            total += p
        assert got == pytest.approx(math.log10(total))


def test_expected_counts_are_exact(monkeypatch):
    monkeypatch.setattr(markov, "CLASSES", 5)
    m = small_model(3, 5)
    codes = [np.array([0, 1, 4]), np.array([2]), np.array([3, 3])]
    k = markov.STATES
    want = [np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, 5))]
    for c in codes:
        paths = list(itertools.product(range(k), repeat=len(c)))
        p = np.array([m.start[s[0]] * np.prod([m.emit[s[t], c[t]] for t in range(len(c))]) * np.prod([m.move[s[t - 1], s[t]] for t in range(1, len(c))]) for s in paths])
        for weight, s in zip(p / p.sum(), paths):
            want[0][s[0]] += weight
            for t, state in enumerate(s):
                want[1][state] += weight
                want[3][state, c[t]] += weight
                if t:
                    want[2][s[t - 1], state] += weight
    for got, expected in zip(markov.expected_counts(m, codes), want):
        np.testing.assert_allclose(got, expected, rtol=1e-4, atol=1e-5)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(markov, "CHUNK_TOKENS", 10)
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "a " * 30_000), (4, "Ä a\x0bb"), (5, "zz")]
    docs = spark.createDataFrame([(k, t, 1.0, "z") for k, t in rows], "doc_id long, text string, score double, word string")
    got = markov.lm_scores(docs)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = got.collect()
    assert sorted(r.n_tokens for r in out) == sorted(len(words_of(t)) + 1 for _, t in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert markov.lm_scores(docs.limit(0)).count() == 0
    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = markov.lm_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()[0]
    assert (only.held_out, only.n_known, only.train_tokens) == (True, 0, 0) and only.score == pytest.approx(0)


def test_every_word_has_emissions_of_its_own(spark, monkeypatch):
    """Two words of a class lie in the states as their own texts do; all tokens of all training texts count, also of a long one."""
    seen = {}
    weights, states = markov._word_weights, markov._word_states
    monkeypatch.setattr(markov, "_word_states", lambda *a: seen.setdefault("states", markov.stored(states(*a))))
    monkeypatch.setattr(markov, "_word_weights", lambda *a: seen.setdefault("weights", markov.stored(weights(*a))))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}{n}" for n in rng.integers(0, 3000, 100)) for i in range(200)]
    texts.append(" ".join(f"a{n}" for n in rng.integers(0, 3000, 4000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = markov.lm_scores(docs).collect()
    counts = {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*words_of(t), " "]:
                counts[w] = counts.get(w, 0) + 1
    assert len(got) == len(texts)
    found = {r["word"].decode(): sum(r[f"e{k}"] for k in range(markov.STATES)) / markov.UNIT for r in seen["states"].collect()}
    assert found == pytest.approx(counts, rel=1e-3) and len(counts) > markov.CLASSES
    classes, total = {}, np.zeros(markov.STATES)
    for r in seen["weights"].collect():
        c, kind = divmod(r["packed"], markov.CLASSES)
        w = np.array(r["w"], np.float64)
        assert c == counts[r["word"].decode()] and w.sum() == pytest.approx(c + 1, rel=1e-5)
        classes.setdefault(kind, []).append(w / w.sum())
        total += w
    assert any(np.abs(np.array(c) - c[0]).max() > 0.01 for c in classes.values() if len(c) > 1)
    assert total.sum() == pytest.approx(sum(counts.values()) + len(counts), rel=1e-5)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
