"""The Parzen search, the silhouette and the threshold generator against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from acervo.operators import generator as G, models as M, search as S

SPACE = {"a": (0, 199), "b": (5, 30), "c": (2, 10)}


def hill(s):
    return -((s["a"] - 140) / 40) ** 2 - ((s["b"] - 9) / 6) ** 2 - ((s["c"] - 8) / 3) ** 2


def test_densities_are_densities():
    for values in ([], [3], [0, 0, 199, 7]):
        p = S.Parzen(values, 0, 199)
        assert sum(p.density(x) for x in range(200)) == pytest.approx(1.0)
    p = S.Parzen([10, 11, 12], 0, 199)
    assert p.density(11) > 5 * p.density(120)
    rng = random.Random(1)
    drawn = [p.draw(rng) for _ in range(4000)]
    assert min(drawn) >= 0 and max(drawn) <= 199
    assert sum(8 <= x <= 14 for x in drawn) / 4000 == pytest.approx(sum(p.density(x) for x in range(8, 15)), abs=0.08)


def test_search_beats_random_settings():
    found, drawn = [], []
    for seed in range(30):
        history = S.parzen_search(SPACE, lambda many: [hill(s) for s in many], trials=20, seed=seed)
        assert [h["trial"] for h in history] == list(range(1, 21)) and all(lo <= h[n] <= hi for h in history for n, (lo, hi) in SPACE.items())
        found.append(max(h["score"] for h in history))
        rng = random.Random(1000 + seed)
        drawn.append(max(hill({n: rng.randint(*r) for n, r in SPACE.items()}) for _ in range(20)))
    assert np.mean(found) > np.mean(drawn) + 0.1 and np.median(found) > np.median(drawn)
    again = S.parzen_search(SPACE, lambda many: [hill(s) for s in many], trials=20, seed=3)
    assert max(h["score"] for h in again) == found[3]


def test_forest_history(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), int(x + 0.3 * rng.normal() > 0)) for i, (x, y) in enumerate(rng.normal(size=(160, 2)))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, target int")
    out = M.tune_rf(df, trials=3, parallelism=1).collect()
    assert sorted(r["trial"] for r in out) == [1, 2, 3] and sorted({r["rodada"] for r in out}) == [0, 1]
    assert [r["precision"] for r in out] == sorted((r["precision"] for r in out), reverse=True)
    assert all(50 <= r["n_estimators"] <= 200 and 5 <= r["max_depth"] <= 30 and 2 <= r["min_samples_split"] <= 10 for r in out)


def plain_silhouette(x, c):
    out = []
    for i in range(len(x)):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        own = (c == c[i]).sum() - 1
        if not own:
            out.append(0.0)
            continue
        a = far[c == c[i]].sum() / own
        b = min(far[c == k].mean() for k in set(c.tolist()) - {c[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_is_euclidean(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(40, 3)), rng.normal(size=(25, 3)) + 3, rng.normal(size=(1, 3)) - 9])
    c = np.array([4] * 40 + [0] * 25 + [7])
    df = spark.createDataFrame([(Vectors.dense(p), int(k)) for p, k in zip(x, c)], ["features", "prediction"])
    assert M.silhouette(df.repartition(5)) == pytest.approx(plain_silhouette(x, c), rel=1e-12)
    assert M.silhouette(df.where("prediction = 0")) == 0.0  # one cluster has no other


def test_silhouette_sample(spark, monkeypatch):
    points = spark.range(500).select(F.col("id").alias("usuario_id"))
    assert M.silhouette_sample(points, "usuario_id").count() == 500
    monkeypatch.setattr(M, "SILHOUETTE_SAMPLES", 60)
    some = {r[0] for r in M.silhouette_sample(points, "usuario_id").collect()}
    assert len(some) == 60 and some == {r[0] for r in M.silhouette_sample(points.repartition(7), "usuario_id").collect()}


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    gen, dis = G.new_layers([G.NOISE + 4, 6, 5, 1], rng), G.new_layers([1 + 4, 6, 3, 1], rng)
    x, y, z = rng.normal(size=(9, 4)), 0.3 + 0.4 * rng.random((9, 1)), rng.normal(size=(9, G.NOISE))
    g_grad, d_grad, _, _ = G.gradients(gen, dis, x, y, z)
    for layers, grad, which in ((gen, g_grad, 2), (dis, d_grad, 3)):
        values, got = G.flat(layers), G.flat(grad)
        for i in rng.choice(len(values), 60, replace=False):
            ends = []
            for move in (1e-6, -1e-6):
                moved = values.copy()
                moved[i] += move
                moved = G.shaped(moved, layers)
                ends.append(G.gradients(*((moved, dis) if which == 2 else (gen, moved)), x, y, z)[which])
            assert got[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_noise_is_normal_and_repeats():
    z = G.noise(np.arange(-5000, 5000), 7)
    assert abs(z.mean()) < 0.02 and z.std() == pytest.approx(1.0, abs=0.02) and abs(np.corrcoef(z.T) - np.eye(G.NOISE)).max() < 0.05
    assert (z[10:20] == G.noise(np.arange(-5000, 5000)[10:20], 7)).all() and (z != G.noise(np.arange(-5000, 5000), 8)).all()


def test_generator_learns_thresholds_of_conditions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float([0.3, 0.6, 0.8][int(x * 3)]), 0.5, "train" if i % 4 else "test") for i, x in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "usuario_id bigint, f double, best_threshold double, best_precision double, split string")
    model = G.train_generator(df.where("split = 'train'"), epochs=80)
    out = G.generate_threshold(model, df)
    assert out.where("limiar < 0.25 OR limiar > 0.85").count() == 0 and out.count() == 200
    error = {r["split"]: r["mae"] for r in M.threshold_error(out).collect()}
    constant = np.mean([abs(r[2] - 0.6) for r in rows])
    assert error["test"] < 0.7 * constant
    assert model.losses[-1][0] < model.losses[0][0] and all(math.isfinite(a) and math.isfinite(b) for a, b in model.losses)
    other = G.train_generator(df.where("split = 'train'").repartition(7), epochs=5)
    same = G.train_generator(df.where("split = 'train'"), epochs=5)
    assert np.allclose(G.flat(other.layers), G.flat(same.layers), atol=1e-9)
    with pytest.raises(ValueError):
        G.train_generator(df.where("split = 'none'"))
