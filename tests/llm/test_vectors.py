"""Vector passes against all pairs."""

import numpy as np
import pytest

from acervo.llm import vectors


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, least):
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                linked[i, j] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least
    group = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([group[i], *(group[j] for j in np.flatnonzero(linked[i]))])
            moved |= low != group[i]
            group[i] = low
    least_key = {}
    for g, (k, _, _) in zip(group, rows):
        if k is not None:
            least_key[g] = min(k, least_key.get(g, k))
    return sorted(((k, int(linked[i].sum()), least_key.get(group[i]), k is not None and k == least_key.get(group[i])) for i, (k, _, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert result(vectors.near_vectors(table)) == brute(rows, 0.93)


@pytest.mark.parametrize("block, chunk, window", [(1024, 1024, 32), (7, 10, 8)])
def test_groups_larger_than_a_window(spark, monkeypatch, block, chunk, window):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 16))
    rows = [(i, [float(x) for x in base[i % 3] + rng.normal(0, 0.06, 16)], i % 2) for i in range(120)]
    rows += [(200 + i, [float(x) for x in rng.normal(size=16)], 0) for i in range(60)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = result(vectors.near_vectors(table, window=window)), brute(rows, 0.93)
    links = [sum(r[1] for r in x) for x in (got, want)]
    assert links[0] <= links[1] and links[0] >= 0.98 * links[1]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], None), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [nan, 1.0], "a"),
            (7, [inf, 0.0], "a"), (8, [None, 1.0], "a"), (9, [], "a"), (10, [1.0, 0.0, 0.0], "a"), (None, [1.0, 0.01], "a"), (None, [0.0, 1.0], "b"),
            (11, [1e300, 0.0], "a"), (12, [-1.0, 0.0], "a"), (13, [1.0, 0.0], "b"), (None, None, None)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label string, n_links int, kept int")
    got = vectors.near_vectors(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert result(got) == brute(rows, 0.93)
    assert vectors.near_vectors(table.limit(0)).count() == 0
    assert vectors.near_vectors(table.where("vec_id in (4, 5)")).count() == 2


def test_passes_find_planted_pairs_of_a_large_label():
    n, pairs, d = 100_000, 1000, 64
    assert vectors.passes_for(0) == vectors.passes_for(10_000) == 16 and vectors.passes_for(1_500_000) == 44
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(pairs, d))
    away -= (away * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x[-pairs:] = 0.93 * x[:pairs] + np.sqrt(1 - 0.93**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    codes = np.concatenate([vectors._codes(x[i : i + 4096], vectors.passes_for(n)) for i in range(0, n, 4096)])
    ranks = codes.argsort(0, kind="stable").argsort(0)
    assert (abs(ranks[:pairs] - ranks[-pairs:]) <= vectors.WINDOW).any(1).mean() >= 0.995


def test_near_vectors_takes_passes_from_the_largest_label(spark, monkeypatch):
    used = []
    plain = vectors._pass_rows
    monkeypatch.setattr(vectors, "_pass_rows", lambda classes, passes: used.append(passes) or plain(classes, passes))
    monkeypatch.setattr(vectors, "FEW", 10)
    rows = [(i, [float(i), 1.0], "a" if i < 40 else "b") for i in range(50)]
    vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).count()
    assert used == [vectors.passes_for(40)] and used[0] > vectors.PASSES
