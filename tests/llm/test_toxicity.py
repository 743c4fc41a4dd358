"""Gradients against differences, windows over whole texts, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from acervo.llm import toxicity as tox


def test_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tox.start_params(1).items()}
    words, mask = ["ab", "cde", "f"], np.array([[1, 1, 1, 0], [1, 1, 0, 0]], bool)
    ids = np.where(mask, rng.integers(0, 3, (2, 4)), 0)
    wanted, cost, use = np.array([1.0, 0.0]), np.array([1.0, 3.0]), np.array([1.0, 0.0, 1.0])

    def loss():
        terms, _ = tox.word_inputs(p, words, use=use)
        logit, _ = tox.window_logits(p, terms, ids, mask)
        chance = tox.sigmoid(logit)
        return float(-(cost * (wanted * np.log(chance) + (1 - wanted) * np.log(1 - chance))).sum() / cost.sum())

    found = tox.gradient(p, words, ids, mask, wanted, cost, use)
    for name, g in found.items():
        flat = np.abs(g).ravel().argsort()[-3:]
        for i in flat:
            at = np.unravel_index(i, g.shape)
            keep, step = p[name][at], 1e-2
            p[name][at] = keep + step
            up = loss()
            p[name][at] = keep - step
            down = loss()
            p[name][at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-4), name


@pytest.mark.parametrize("n", [0, 1, tox.WINDOW, tox.WINDOW + 1, 500])
def test_windows_cover_all_tokens(n):
    place, mask, text = tox.windows(np.array([3, n]))
    mine = place[text == 1][mask[text == 1]]
    assert sorted(set(mine)) == list(range(3, 3 + n))
    assert (text == 1).sum() == max(1, -(-(n - tox.WINDOW) // tox.STRIDE) + 1 if n > tox.WINDOW else 1)


def sample(n, seed, stems=("gruk", "blarf")):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeiorstnl", k=rng.randrange(2, 8))) for _ in range(rng.randrange(5, 150))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["a", "en", "ist", "o", ""])
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_learns_stems_wherever_they_stand():
    params = tox.train(*sample(600, 1))
    texts, labels = sample(300, 2)
    found = tox.Scorer(params).score(texts) >= 0.5
    assert (found == labels).mean() > 0.95
    long = "rise tone " * 4000
    scores = tox.Scorer(params).score([long + "gruken", long, "gruka " + long, "gruken", ""])
    assert scores[0] > 0.5 and scores[2] > 0.5 and scores[3] > 0.5 and scores[1] < 0.5 and 0 <= scores[4] <= 1


def test_one_label_only():
    params = tox.train(["a b", "c"], np.array([0, 0]))
    assert tox.Scorer(params).score(["a", ""]) == pytest.approx([1 / 4] * 2)


def test_table(spark):
    texts, labels = sample(400, 3)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, None, 0.5), (1000, "", 0.1), (1000, "", 0.1)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = tox.score_texts(docs, tox.fit(docs, marks))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == 403
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    right = [r.predicted == labels[r.doc_id] for r in out if r.held_out and r.doc_id < 400]
    assert sum(right) / len(right) > 0.9
    nothing = tox.fit(docs.limit(0), marks.limit(0))
    assert tox.score_texts(docs.limit(0), nothing).count() == 0
