import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.operators import features as FE, models as M, ranker as K


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(42)
    x = rng.random((200, 5))
    rows = [(i, *map(float, r), int(r[0] + r[1] > 1)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, e double, target int")


@pytest.fixture(scope="module")
def forest(separable):
    return M.train_quality_rf(separable, trees=20, depth=5)


def test_forest_learns(separable, forest):
    out = M.predict_quality(forest, separable)
    p = [r["probabilidade"] for r in out.collect()]
    assert len(p) == 200 and min(p) >= 0.0 and max(p) <= 1.0
    assert out.where("previsto = target").count() > 180
    assert M.average_precision(out, "target", "probabilidade").first()["ap"] > 0.95


def test_save_and_load(separable, forest, tmp_path):
    path = str(tmp_path / "model")
    M.save_model(forest, path)
    a = [tuple(r) for r in M.predict_quality(forest, separable).orderBy("id").collect()]
    assert a == [tuple(r) for r in M.predict_quality(M.load_model(path), separable).orderBy("id").collect()]
    with pytest.raises(FileNotFoundError):
        M.load_model(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        M.predict_quality(None, separable)
    with pytest.raises(ValueError):
        M.save_model(None, path)


def test_missing_columns_are_refused(separable, forest):
    with pytest.raises(Exception):
        M.predict_quality(forest, separable.drop("a")).collect()


def test_class_weights_balance(separable):
    w = {r["target"]: r["s"] for r in M.balanced_weights(separable).groupBy("target").agg(F.sum("peso").alias("s")).collect()}
    assert w[0] == pytest.approx(100.0) and w[1] == pytest.approx(100.0)


def test_average_precision_with_ties(spark):
    y, s = [1, 0, 1, 1, 0, 0], [0.9, 0.9, 0.5, 0.4, 0.4, 0.1]
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    # thresholds .9, .5, .4: (recall step, precision) = (1/3, 1/2), (1/3, 2/3), (1/3, 3/5)
    assert M.average_precision(df).first()["ap"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)
    r = M.threshold_report(df, [0.95]).first()
    assert (r["tp"], r["fp"], r["precision"], r["f1"]) == (0, 0, 0.0, 0.0)


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = (rng.random((30, 20)) < 0.4) * rng.random((30, 20))
    a[:, 3] += 2 * rng.random(30)  # an item nearly everybody has
    edges = spark.createDataFrame([(u, i, float(a[u, i])) for u in range(30) for i in range(20) if a[u, i]], "usuario_id bigint, item bigint, peso double")
    users, items, s = K.train_svd(edges, k=6, extra=14, rounds=2)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(s, want[:6], rtol=1e-6)
    u = {r["usuario_id"]: r["vetor"] for r in users.collect()}
    v = {r["item"]: r["vetor"] for r in items.collect()}
    approx = np.array([u.get(i, [0.0] * 6) for i in range(30)]) @ np.array([v.get(i, [0.0] * 6) for i in range(20)]).T
    uu, ss, vv = np.linalg.svd(a)
    assert np.allclose(approx, (uu[:, :6] * ss[:6]) @ vv[:6], atol=1e-6)
    x = (uu[:, :6] * ss[:6])
    share = K.explained_variance(edges, users, 30).first()[0]
    assert share == pytest.approx(x.var(axis=0).sum() / a.var(axis=0).sum(), rel=1e-6)


def test_rank_above_the_matrix(spark):
    edges = spark.createDataFrame([(1, 1, 1.0), (2, 2, 2.0)], "usuario_id bigint, item bigint, peso double")
    _, _, s = K.train_svd(edges, k=50)
    assert np.allclose(s, [2.0, 1.0])


def test_clusters_and_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=3) * 0.1 + 5 * (i % 4)), 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "usuario_id bigint, a double, b double, c double, fixed double")
    out, k, score = M.user_clusters(df, low=3, high=6)
    assert k == 4 and score > 0.9
    assert out.groupBy((F.col("usuario_id") % 4).alias("g")).agg(F.count_distinct("cluster").alias("n")).where("n <> 1").count() == 0
    points, _ = M.pca_95(df, "usuario_id")
    assert len(points.first()["features"]) == 1  # three copies of one direction


def test_threshold_model_stays_in_range(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float([0.3, 0.6, 0.8][int(x * 3)]), 0.5) for i, x in enumerate(rng.random(90))]
    df = spark.createDataFrame(rows, "usuario_id bigint, f double, best_threshold double, best_precision double")
    data = M.threshold_dataset(df.drop("best_threshold", "best_precision"), df.drop("f"))
    assert {r["split"] for r in data.select("split").distinct().collect()} == {"train", "val", "test"}
    out = M.predict_threshold(M.train_threshold_model(data.where("split = 'train'")), data)
    assert out.where("limiar < 0.25 OR limiar > 0.85").count() == 0
    assert all(r["mae"] < 0.1 for r in M.threshold_error(out).collect())


def test_feature_edges(spark):
    import datetime as dt

    at = lambda day: dt.datetime(2020, 1, day)
    rows = [(1, 10, at(1), 2.0), (1, 11, at(2), None), (2, 10, at(3), 0.0)]
    s = spark.createDataFrame(rows, "usuario_id bigint, jogo_id bigint, inicio timestamp_ntz, horas_jogadas double")
    games = spark.createDataFrame([(10,), (11,)], "id bigint")
    bridge = spark.createDataFrame([(10, "RPG"), (10, "Action")], "jogo_id bigint, nome string")
    share = {r["usuario_id"]: (r["Action"], r["Unknown"]) for r in FE.user_genre_share(s, games, bridge).collect()}
    assert share == {1: (1.0, 0.0), 2: (0.0, 0.0)}  # no hours: zeros
    eng = {r["usuario_id"]: r for r in FE.user_engagement(s).collect()}
    assert (eng[1]["total_sessoes"], eng[1]["total_horas"], eng[2]["total_jogos_unicos"]) == (1, 2.0, 1)
    freq = FE.session_frequency(FE.user_engagement(s), F.lit(at(3)).cast("timestamp_ntz"))
    assert {r["usuario_id"]: r["frequencia"] for r in freq.collect()} == {1: 0.5, 2: 1.0}
    assert {r["k"] for r in FE.minmax(s.select(F.lit(3.0).alias("k")), "k").collect()} == {0.0}
    w = {(r["usuario_id"], r["item"]): r["peso"] for r in FE.interactions(s.unionByName(s)).collect()}
    assert w[(1, 10)] == pytest.approx(2 * (np.log1p(2.0) + 1)) and w[(1, 11)] == 2.0
    assert FE.good_game_label(games.withColumn("avaliacao_media", F.lit(None).cast("double"))).first()["target"] == 0


def test_iterated_rows_are_spread_over_the_cores(spark):
    from acervo.session import cut_lineage, spread

    rows = spark.range(30_000)
    assert cut_lineage(rows.repartition("id")).rdd.getNumPartitions() == 1  # some KB: adaptive execution takes one task
    even = spread(rows, "id")
    assert even.rdd.getNumPartitions() == 3 and even.distinct().count() == 30_000


def test_forests_keep_the_nodes_of_their_rows(spark):
    rows = spark.range(60).selectExpr("id", "double(id % 7) AS a", "double(id) AS b", "int(id >= 30) AS target")
    model = M.train_quality_rf(rows, trees=3, depth=3)
    assert model.stages[1].getOrDefault("cacheNodeIds")


def test_starts_run_side_by_side_give_the_same_clusters(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(200).selectExpr("id AS usuario_id", "double(id % 4 * 10 + id / 1000) AS a", "double(id % 2) AS b")
    points = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("usuario_id", "features")
    alone, together = (M.best_kmeans(points, 3, 5, starts=3, parallelism=n) for n in (1, 6))
    assert alone[0].getK() == together[0].getK() == 4 and alone[1] == together[1]


def test_products_move_no_row_for_a_single_weight(spark, monkeypatch):
    """300 users with 40 of 60 items each, in 3 x 2 blocks: the product's partial sums, not its 12,000 weights, are what is grouped; results stay."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 100)
    monkeypatch.setattr(K, "block_count", lambda n: 3 if n == 300 else 2)
    edges = spark.range(300).selectExpr("id AS usuario_id", "explode(sequence(0, 39)) AS j").selectExpr(
        "usuario_id", "(usuario_id + j) % 60 AS item", "double(1 + (usuario_id * 7 + j) % 5) AS peso")
    grid = K._grid(edges)
    needs = K._needs(grid, "item", "_ub")
    factor = needs.select("item", F.array(F.col("item").cast("double"), F.lit(1.0)).alias("v"))
    out = K._times(grid, factor, needs, "item", "usuario_id", 2)
    got = {r["usuario_id"]: r["v"] for r in out.collect()}
    want = {r["usuario_id"]: [r["a"], r["b"]] for r in edges.groupBy("usuario_id").agg(F.sum(F.col("peso") * F.col("item")).alias("a"), F.sum("peso").alias("b")).collect()}
    assert got == want
    assert needs.select(F.sum(F.size("_others"))).first()[0] <= 60 * 3 and "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().toString()


def test_pivot_by_user_shuffles_no_wide_rows(spark, sf):
    """Hours meet their user in one shuffle; the pivot's rows of all genres stay in place."""
    from acervo.plans import bindings as B

    wide = FE.genre_hours(B.sessions(spark, sf), B.games(spark, sf), B.game_categories(spark, sf))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("pivotfirst", plan.index("pivotfirst") + 1)] if plan.count("pivotfirst") > 1 else plan
    assert "Exchange" not in before[before.index("pivotfirst") :]
    assert "repartition" in plan.lower() or "REPARTITION_BY_COL" in plan


def test_svd_by_strips_keeps_one_product_at_a_time(spark, monkeypatch):
    """Strips of columns give the factors of whole products; of all tables written only the two results stay."""
    import os

    from acervo.session import shared_root

    edges = spark.range(120).selectExpr("id AS usuario_id", "explode(sequence(0, 9)) AS j").selectExpr(
        "usuario_id", "(usuario_id * 3 + j * j) % 50 AS item", "double(1 + (usuario_id * 7 + j * 5) % 11) AS peso")
    tables = lambda: {x for x in os.listdir(shared_root(spark).removeprefix("file:")) if x.startswith("rows-")}
    before = tables()
    vectors = lambda df: {r[0]: r["vetor"] for r in df.collect()}
    users, items, s = K.train_svd(edges, k=4, extra=6, rounds=2)
    whole = vectors(users), vectors(items)
    assert len(tables() - before) == 2
    monkeypatch.setattr(K, "STRIP_BYTES", 4_000)
    monkeypatch.setattr(K, "block_count", lambda n: 3 if n == 120 else 2)
    assert len(K._strips(K._needs(K._grid(edges), "item", "_ub"), 10)) > 2
    users, items, again = K.train_svd(edges, k=4, extra=6, rounds=2)
    np.testing.assert_allclose(again, s, rtol=1e-9)
    for now, then in zip((vectors(users), vectors(items)), whole):
        assert now.keys() == then.keys()
        np.testing.assert_allclose([now[k] for k in then], list(then.values()), atol=1e-8)


def test_pairs_of_blocks_hold_few_weights(spark, monkeypatch):
    monkeypatch.setattr(K, "PAIR_EDGES", 100)
    edges = spark.range(1200).selectExpr("id % 60 AS usuario_id", "id DIV 60 AS item", "1.0D AS peso")
    grid = K._grid(edges)
    sizes = [r["count"] for r in grid.groupBy("_ub", "_ib").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) >= 12
    plan = grid.groupBy("_ub", "_ib").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # pairs lie in buckets
