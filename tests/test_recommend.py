import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.fixed_values import COLD_START_TEXT, KNOWN_USER_TEXT, MODES
from acervo.operators import evaluate as E, recommend as R, tiles
from acervo.operators.tiles import top_per_row
from acervo.plans import bindings as B


def key(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(42)
    users = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(10)]
    items = [(100 + i, [float(x) for x in rng.normal(size=5)]) for i in range(50)]
    return (
        spark.createDataFrame(users, "usuario_id bigint, vetor array<double>"),
        spark.createDataFrame(items, "id bigint, vetor array<double>"),
        dict(users), dict(items),
    )


def small_tiles(monkeypatch, rows):
    monkeypatch.setattr(R, "tile_map", functools.partial(tiles.tile_map, rows=rows))


def test_top_per_row_breaks_ties_by_column():
    s = np.array([[1.0, 3.0, 3.0, 3.0], [0.0, 0.0, 0.0, 9.0]])
    rows, cols = top_per_row(s, 2)
    assert list(zip(rows, cols)) == [(0, 1), (0, 2), (1, 3), (1, 0)]
    assert len(top_per_row(s, 9)[0]) == 8 and len(top_per_row(s, 0)[0]) == 0


def test_blocks_do_not_change_the_lists(vectors, monkeypatch):
    users, items, _, _ = vectors
    whole = key(R.recommend_modes(users, items, 10)), key(R.top_items(users, items, 4)), key(
        R.score_summary(users, items).select("usuario_id", "n_itens", "n_70", "n_50", "n_30"))
    small_tiles(monkeypatch, 7)
    cut = key(R.recommend_modes(users, items, 10)), key(R.top_items(users, items, 4)), key(
        R.score_summary(users, items).select("usuario_id", "n_itens", "n_70", "n_50", "n_30"))
    for a, b in zip(whole, cut):
        assert [x[:4] for x in a] == [x[:4] for x in b]


def test_lists_follow_the_mode_rules(vectors):
    users, items, u, v = vectors
    out = R.recommend_modes(users, items, 10).collect()
    for name, m in MODES.items():
        for uid, vec in u.items():
            mine = [r for r in out if r["modo"] == name and r["usuario_id"] == uid]
            scores = {i: float(np.dot(vec, w)) for i, w in v.items()}
            valid = [i for i in scores if scores[i] >= m["threshold"]] or sorted(scores, key=scores.get)[-20:]
            n_explore = int(10 * m["exploracao"])
            want_top = sorted(valid, key=lambda i: (-scores[i], i))[: 10 - n_explore]
            assert [r["item"] for r in sorted(mine, key=lambda r: r["rank"]) if r["origem"] == "topo"] == want_top
            explored = [r["item"] for r in mine if r["origem"] == "exploracao"]
            assert len(explored) == min(n_explore, max(0, len(valid) - len(want_top)))
            assert set(explored) <= set(valid) - set(want_top)
            assert len({r["item"] for r in mine}) == len(mine) <= 10


def test_text_ids_give_the_same_best_items(vectors):
    users, items, _, _ = vectors
    name = lambda c: F.concat(F.lit("id-"), F.lpad(F.col(c).cast("string"), 4, "0"))
    named = R.recommend_modes(users.withColumn("usuario_id", name("usuario_id")), items.withColumn("id", name("id")), 10)
    plain = R.recommend_modes(users, items, 10).withColumn("usuario_id", name("usuario_id")).withColumn("item", name("item"))
    top = lambda df: key(df.where("origem = 'topo'").select("usuario_id", "modo", "rank", "item"))
    assert top(named) == top(plain)
    assert named.where("origem = 'exploracao'").count() == plain.where("origem = 'exploracao'").count()
    assert R.top_items(users.withColumn("usuario_id", name("usuario_id")), items, 2).dtypes[0] == ("usuario_id", "string")


def test_draws_of_any_key(spark):
    import hashlib

    from acervo.functions.sampling import PAIR_DRAWS, column_term, draw, row_terms

    number = lambda k, seed: int(hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:15], 16)
    df = spark.createDataFrame([(2**62, "é x")], "a bigint, b string")
    f, o = row_terms(F.col("b"), 42)
    got = df.select(draw(F.col("a"), 42), f, o, column_term(F.col("a"), 42)).first()
    assert tuple(got) == (number(2**62, 42), 1 + number("é x", 42) % (PAIR_DRAWS - 1), number("é x", 43) % PAIR_DRAWS, number(2**62, 44) % PAIR_DRAWS)


def test_bad_arguments(vectors):
    users, items, _, _ = vectors
    with pytest.raises(ValueError):
        R.recommend(users, items, 10, "ousado")
    with pytest.raises(ValueError):
        R.recommend(users, items, 0)


def test_cold_start(spark, vectors):
    users, _, u, _ = vectors
    asked = spark.createDataFrame([(3,), (999,)], "usuario_id bigint")
    got = {r["usuario_id"]: r for r in R.with_cold_start(asked, users.withColumnRenamed("usuario_id", "id")).collect()}
    assert got[3]["explicacao"] == KNOWN_USER_TEXT and got[999]["explicacao"] == COLD_START_TEXT
    assert np.allclose(got[999]["vetor"], np.mean(list(u.values()), axis=0)) and got[3]["vetor"] == u[3]


def test_constant_scores_fall_back(spark):
    users = spark.createDataFrame([(1, [0.0, 0.0])], "usuario_id bigint, vetor array<double>")
    items = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "id bigint, vetor array<double>")
    truth = spark.createDataFrame([(1, 5), (2, 5)], "usuario_id bigint, item bigint")
    r = R.best_thresholds(users, items, truth).collect()
    assert [(x["usuario_id"], x["best_threshold"], x["best_precision"]) for x in r] == [(1, 0.6, 0.0)]


def test_similar_games_with_repeated_and_lonely_sets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    games = [(i, float(rng.integers(0, 5))) for i in range(60)]
    cats = [(i, f"c{c}") for i in range(58) for c in (rng.choice(5, rng.integers(1, 4), replace=False) if i > 25 else [0])]
    cats += [(58, "only")]
    g = spark.createDataFrame(games, "id bigint, avaliacao_media double")
    b = spark.createDataFrame(cats, "jogo_id bigint, nome string")
    sets = {}
    for i, c in cats:
        sets.setdefault(i, set()).add(c)
    rate = dict(games)
    small_tiles(monkeypatch, 3)
    got = {}
    for r in R.similar_games(g, b, 4).collect():
        got.setdefault(r["jogo_id"], []).append((r["rank"], r["similar_id"], r["categorias_comuns"]))
    for i in range(60):
        near = [(len(sets[i] & sets[j]), rate[j], j) for j in sets if i in sets and j != i and sets[i] & sets[j]]
        want = sorted(near, key=lambda t: (-t[0], -t[1], t[2]))[:4]
        assert [(c, j) for _, j, c in sorted(got.get(i, []))] == [(c, j) for c, _, j in want]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets_with_hot_members(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"c{i}" for i in range(25)]
    share = np.array([1 / (i + 1) for i in range(25)])
    sets = list({tuple(sorted(rng.choice(names, rng.integers(1, 8), replace=False, p=share / share.sum()))) for _ in range(350)})
    rows = [(f"s{i}", list(c), float(rng.integers(0, 4)), i) for i, c in enumerate(sets)]
    leaders = spark.createDataFrame(rows, "sig string, cats array<string>, nota double, id bigint")
    got = {}
    for r in R.similar_sets(leaders, 6).collect():
        got.setdefault(r["sig"], set()).add((r["par"], r["comuns"]))
    for sig, c, _, _ in rows:
        near = sorted(((len(set(c) & set(d)), nota, i) for _, d, nota, i in rows if set(c) & set(d)), key=lambda t: (-t[0], -t[1], t[2]))[:6]
        assert got[sig] == {(f"s{i}", n) for n, _, i in near}


def test_holdout_spreads_one_busy_user(spark):
    rows = [(1, f"2020-01-{1 + i // 24:02d} {i % 24:02d}:00:00", i % 17) for i in range(500)] + [(2, "2020-01-01 00:00:00", 3)]
    df = spark.createDataFrame(rows, "usuario_id int, t string, jogo_id int").select(
        "usuario_id", "jogo_id", F.to_timestamp("t").cast("timestamp_ntz").alias("inicio"))
    got = {(r["usuario_id"], r["item"]) for r in R.holdout_latest(df, 0.02).collect()}
    assert got == {(1, i % 17) for i in range(490, 500)} | {(2, 3)}


def test_cascade_keeps_good_items(spark):
    recs = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "usuario_id int, item int")
    out = R.cascade(recs, spark.createDataFrame([(5,)], "item int"), spark.createDataFrame([(1, 3)], "usuario_id int, cluster int"))
    assert key(out.select("usuario_id", "item", F.coalesce("cluster", F.lit(-1)))) == [(1, 5, 3), (2, 5, -1)]


def test_list_measures_on_edge_lists(spark):
    recs = spark.createDataFrame(
        [(1, 1, 10), (1, 2, 11), (1, 3, 10), (2, 1, 12), (3, 1, 10)], "usuario_id int, rank int, item int")
    truth = spark.createDataFrame([(1, 10), (1, 99), (2, 77), (9, 10)], "usuario_id int, item int")
    got = {r["usuario_id"]: r for r in E.user_measures(recs, truth, [2, 5]).collect()}
    assert got[1]["precision_5"] == pytest.approx(2 / 5)  # a repeated item counts twice, k divides
    assert got[1]["recall_2"] == pytest.approx(0.5) and got[1]["rr"] == 1.0
    assert got[1]["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert got[1]["ndcg_2"] == pytest.approx(1 / (1 + 1 / np.log2(3)))
    assert all(got[2][c] == 0.0 for c in ("precision_5", "recall_5", "ndcg_5", "ap", "rr"))
    assert all(got[3][c] == 0.0 for c in ("precision_5", "recall_5", "ndcg_5", "ap", "rr"))  # no truth
    assert E.map_at_k(recs, truth.where("usuario_id > 5"), 5).first()["map"] == 0.0


def test_gini_bounds(spark):
    catalog = spark.createDataFrame([(i,) for i in range(10)], "item int")
    flat = spark.createDataFrame([(i, 1, i) for i in range(10)], "usuario_id int, rank int, item int")
    one = spark.createDataFrame([(i, 1, 4) for i in range(10)], "usuario_id int, rank int, item int")
    assert E.gini(flat, catalog).first()["gini"] == pytest.approx(0.0)
    assert E.gini(one, catalog).first()["gini"] == pytest.approx(0.9)
    assert E.gini(one.where("item > 9"), catalog).first()["gini"] == 0.0
    profiles = spark.createDataFrame([(1, "A")], "usuario_id int, perfil string")
    names = {r["perfil"] for r in E.precision_by_profile(one, one.select("usuario_id", "item"), profiles).collect()}
    assert names == {"A", "UnknownProfile"}


def test_session_minutes_default_and_log(spark, tmp_path):
    recs = spark.createDataFrame([(1, 1, 0.6), (2, 1, 0.9), (3, 1, 0.1)], "item int, usuario_id int, score double")
    genre = spark.createDataFrame([(1, "RPG"), (2, "Chess")], "item int, genero string")
    assert E.expected_session_minutes(recs, genre).first()["minutos"] == pytest.approx((304 + 120) / 2)
    m = spark.createDataFrame([("a", 1.0)], "metrica string, valor double")
    E.log_metrics(m, "r1", str(tmp_path / "m"))
    E.log_metrics(m, "r2", str(tmp_path / "m"))
    assert key(spark.read.parquet(str(tmp_path / "m"))) == [("r1", "a", 1.0), ("r2", "a", 1.0)]


def test_lists_do_not_depend_on_layout(spark, sf):
    users = B.emb_users(spark, sf).withColumnRenamed("id", "usuario_id")
    items = B.emb_items(spark, sf)
    a = R.recommend(users, items, 10, "aventureiro").select("usuario_id", "rank", "item")
    b = R.recommend(users.repartition(5), items.repartition(3), 10, "aventureiro").select("usuario_id", "rank", "item")
    assert key(a) == key(b)


def test_users_with_one_vector_are_scored_once(spark, vectors):
    """Lists of users who share a vector are those of each user alone; a block scores the shared vector a single time."""
    _, items, _, _ = vectors
    users = spark.createDataFrame([(i, [1.0, -0.5, 0.25, 0.0, 2.0] if i % 4 else [0.1 * i, 0.0, 1.0, 0.0, 0.0]) for i in range(12)], "usuario_id bigint, vetor array<double>")
    together = key(R.recommend_modes(users, items, 10))
    alone = [row for u in range(12) for row in key(R.recommend_modes(users.where(F.col("usuario_id") == u), items, 10))]
    assert [x[:4] + x[5:] for x in together] == [x[:4] + x[5:] for x in sorted(alone)]
    assert key(R.recommend_modes(users, items, 10, cell_rows=9)) == together
    found, number = tiles.distinct_rows(np.array([[1.0, 2.0], [0.0, 1.0], [1.0, 2.0]]))
    assert len(found) == 2 and (found[number] == [[1.0, 2.0], [0.0, 1.0], [1.0, 2.0]]).all()
