"""Registered feature, model and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import features as FE, generator as G, models as M, ranker as K, recommend as R
from acervo.plans import bindings as B, recommend_queries as R_QUERIES
from acervo.plans.bindings import AS_OF, with_views
from acervo.plans.market_queries import r
from acervo.plans.registry import register
from acervo.functions.sampling import split_stratified
from acervo.streaming import sessions as ST

GOOD = 3.5  # rating bound that leaves both classes filled on the bound tables


@register("class_balance", "A-23 F-02", with_views(f"""
    SELECT sum((avaliacao_media >= {GOOD})::INT)::BIGINT AS positivos, sum((avaliacao_media < {GOOD})::INT)::BIGINT AS negativos,
           round(avg((avaliacao_media >= {GOOD})::INT), 6) AS proporcao,
           round(sum((avaliacao_media >= {GOOD})::INT) / sum((avaliacao_media < {GOOD})::INT)::DOUBLE, 6) AS desequilibrio FROM games""", "games"))
def _(s, d):
    return FE.class_balance(B.games(s, d), GOOD).select("positivos", "negativos", r("proporcao"), r("desequilibrio"))


@register("good_game_label", "F-02", with_views(
    "SELECT id, (avaliacao_media >= 4.0)::INT AS target FROM games", "games"))
def _(s, d):
    return FE.good_game_label(B.games(s, d)).select("id", "target")


@register("game_features", "F-01 X-14 X-17 X-23 J-06", with_views(f"""
    WITH top AS (SELECT nome FROM game_categories GROUP BY 1 ORDER BY count(*) DESC, nome LIMIT 20),
    dev AS (SELECT desenvolvedor_id, avg(avaliacao_media) AS m FROM games WHERE desenvolvedor_id IS NOT NULL GROUP BY 1),
    fl AS (SELECT jogo_id, count(*) AS n FROM game_categories WHERE nome IN (SELECT nome FROM top) GROUP BY 1)
    SELECT id, preco_base, metacritic_score::DOUBLE AS metacritic_score,
           round(ln(1 + greatest(coalesce(date_diff('second', data_lancamento, TIMESTAMP '{AS_OF}') // 86400, 3650), 0)), 6) AS idade_log,
           round(coalesce(m, (SELECT avg(avaliacao_media) FROM games)), 6) AS dev_reputacao,
           total_avaliacoes::DOUBLE AS total_avaliacoes, coalesce(n, 0)::INT AS flags
    FROM games LEFT JOIN dev USING (desenvolvedor_id) LEFT JOIN fl ON jogo_id = id""", "games", "game_categories"))
def _(s, d):
    out = FE.game_features(B.games(s, d), B.game_categories(s, d), B.as_of())
    flags = sum((F.col(c) for c in out.columns if c.startswith("cat_")), F.lit(0))
    return out.select("id", "preco_base", "metacritic_score", r("idade_log"), r("dev_reputacao"), "total_avaliacoes", flags.alias("flags"))


GENRE_HOURS = """pg AS (SELECT jogo_id, min(nome) AS genero FROM game_categories GROUP BY 1),
gh AS (SELECT usuario_id, genero, sum(horas_jogadas) AS h FROM sessions JOIN pg USING (jogo_id) GROUP BY 1, 2)"""


def _long(wide, name):
    cols = [c for c in wide.columns if c != "usuario_id"]
    return wide.unpivot(["usuario_id"], cols, "genero", name).where(F.col(name) > 0)


@register("genre_hours", "A-26 J-08", with_views(f"WITH {GENRE_HOURS} SELECT usuario_id, genero, h FROM gh WHERE h > 0", "sessions", "game_categories"))
def _(s, d):
    return _long(FE.genre_hours(B.sessions(s, d), B.games(s, d), B.game_categories(s, d)), "h")


@register("user_genre_share", "F-03 A-26 X-22", with_views(f"""WITH {GENRE_HOURS}
    SELECT usuario_id, genero, round(h / sum(h) OVER (PARTITION BY usuario_id), 9) AS share FROM gh WHERE h > 0""", "sessions", "game_categories"))
def _(s, d):
    out = _long(FE.user_genre_share(B.sessions(s, d), B.games(s, d), B.game_categories(s, d)), "share")
    return out.select("usuario_id", "genero", r("share", 9))


@register("user_engagement", "F-04", with_views("""
    SELECT usuario_id, count(DISTINCT jogo_id) AS total_jogos_unicos, coalesce(sum(horas_jogadas), 0) AS total_horas,
           round(avg(horas_jogadas), 6) AS media_horas_sessao, count(horas_jogadas) AS total_sessoes, min(inicio) AS primeira_sessao
    FROM sessions GROUP BY 1""", "sessions"))
def _(s, d):
    return FE.user_engagement(B.sessions(s, d)).withColumn("media_horas_sessao", r("media_horas_sessao"))


ENG = f"""en AS (SELECT usuario_id, count(DISTINCT jogo_id) AS g, coalesce(sum(horas_jogadas), 0) AS h,
    count(horas_jogadas) / greatest(1, date_diff('second', min(inicio), TIMESTAMP '{AS_OF}') // 86400)::DOUBLE AS f
    FROM sessions GROUP BY 1)"""


@register("session_frequency", "F-05 X-14", with_views(f"WITH {ENG} SELECT usuario_id, round(f, 6) AS frequencia FROM en", "sessions"))
def _(s, d):
    return FE.session_frequency(FE.user_engagement(B.sessions(s, d)), B.as_of()).select("usuario_id", r("frequencia"))


@register("minmax_scaled", "F-06", with_views(f"""WITH {ENG}
    SELECT usuario_id, round((g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ())::DOUBLE, 6) AS jogos_norm FROM en""", "sessions"))
def _(s, d):
    out = FE.minmax(FE.user_engagement(B.sessions(s, d)), "total_jogos_unicos", "jogos_norm")
    return out.select("usuario_id", r("jogos_norm"))


@register("outlier_flag", "F-07", with_views(f"""WITH {ENG}
    SELECT usuario_id, (h >= (SELECT quantile_cont(h, 0.95) FROM en))::INT AS is_outlier FROM en""", "sessions"))
def _(s, d):
    return FE.outlier_flag(FE.user_engagement(B.sessions(s, d))).select("usuario_id", "is_outlier")


@register("mean_play_hour", "X-18 X-13", with_views("""
    SELECT usuario_id, round(cos(2 * pi() * avg(hour(inicio)) / 24), 6) AS hora_cos,
           round(sin(2 * pi() * avg(hour(inicio)) / 24), 6) AS hora_sin FROM sessions GROUP BY 1""", "sessions"))
def _(s, d):
    return FE.mean_hour(B.sessions(s, d)).select("usuario_id", r("hora_cos"), r("hora_sin"))


@register("interactions", "M-07 X-17 J-08", with_views("""
    SELECT usuario_id, jogo_id AS item, round(sum(ln(1 + coalesce(horas_jogadas, 0)) + 1), 6) AS peso FROM sessions GROUP BY 1, 2""", "sessions"))
def _(s, d):
    return FE.interactions(B.sessions(s, d)).select("usuario_id", "item", r("peso"))


@register("average_precision", "M-03", with_views("""
    WITH g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1),
    rn AS (SELECT pos, sum(pos) OVER w / (sum(n) OVER w)::DOUBLE AS p, sum(pos) OVER () AS t FROM g WINDOW w AS (ORDER BY score DESC))
    SELECT round(sum(pos / t::DOUBLE * p), 6) AS ap FROM rn""", "scored"))
def _(s, d):
    return M.average_precision(B.scored(s, d)).select(r("ap"))


@register("pr_curve", "M-03", with_views("""
    WITH g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1)
    SELECT score AS limiar, round(sum(pos) OVER w / (sum(n) OVER w)::DOUBLE, 6) AS precision,
           round(sum(pos) OVER w / (sum(pos) OVER ())::DOUBLE, 6) AS recall FROM g WINDOW w AS (ORDER BY score DESC)""", "scored"))
def _(s, d):
    return M.pr_curve(B.scored(s, d)).select("limiar", r("precision"), r("recall"))


@register("threshold_report", "M-04", with_views("""
    WITH c AS (SELECT t AS limiar, count(*) FILTER (WHERE score >= t AND y = 1) AS tp, count(*) FILTER (WHERE score >= t AND y <> 1) AS fp,
      count(*) FILTER (WHERE score < t AND y = 1) AS fn, count(*) FILTER (WHERE score < t AND y <> 1) AS tn
      FROM scored, (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS t) GROUP BY 1)
    SELECT limiar, tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""", "scored"))
def _(s, d):
    out = M.threshold_report(B.scored(s, d))
    return out.select("limiar", "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("f1"))


@register("genre_share_rows", "A-26 F-03", with_views("""
    WITH pg AS (SELECT jogo_id, min(nome) AS genero FROM game_categories GROUP BY 1),
    h AS (SELECT usuario_id, coalesce(genero, 'Unknown') AS genero, sum(horas_jogadas) AS h
          FROM sessions s JOIN games g ON g.id = s.jogo_id LEFT JOIN pg ON pg.jogo_id = s.jogo_id GROUP BY 1, 2)
    SELECT usuario_id, genero, round(h / sum(h) OVER (PARTITION BY usuario_id), 6) AS share FROM h WHERE h > 0""", "sessions", "games", "game_categories"))
def _(s, d):
    return FE.genre_share_rows(B.sessions(s, d), B.games(s, d), B.game_categories(s, d)).select("usuario_id", "genero", r("share"))


def _labelled(s, d):
    """Game features with target and split; reputation learned on the training part only."""
    games = FE.good_game_label(B.games(s, d), GOOD)
    parts = split_stratified(games.select("id", "target"), "id", ["target"])
    train_games = games.join(parts.where("split = 'train'").select("id"), "id", "left_semi")
    features = FE.game_features(games, B.game_categories(s, d), B.as_of(), fit_on=train_games)
    return features.join(parts, "id")


@register("quality_forest", "M-01 M-02 F-01 O-08")
def _(s, d):
    rows = _labelled(s, d)
    model = M.train_quality_rf(rows.where("split = 'train'"))
    return M.predict_quality(model, rows.where("split = 'test'"))


@register("quality_forest_precision", "M-01 M-03 M-04")
def _(s, d):
    rows = _labelled(s, d)
    model = M.train_quality_rf(rows.where("split = 'train'"))
    out = M.predict_quality(model, rows.where("split = 'test'"))
    return M.threshold_report(out, label="target", score="probabilidade")


@register("quality_forest_rows", "M-01 M-02", with_views(f"""
    SELECT target, round(count(*) * 0.2::DOUBLE)::BIGINT AS linhas, 0::BIGINT AS incoerentes
    FROM (SELECT (avaliacao_media >= {GOOD})::INT AS target FROM games) GROUP BY target""", "games"))
def _(s, d):
    """Predictions of the held-out fifth of each class; none with a probability outside 0..1 or a label that its probability denies."""
    rows = _labelled(s, d)
    out = M.predict_quality(M.train_quality_rf(rows.where("split = 'train'"), trees=20, depth=5), rows.where("split = 'test'"))
    p = F.col("probabilidade")
    wrong = ~p.between(0.0, 1.0) | ((p > 0.5) & (F.col("previsto") == 0)) | ((p < 0.5) & (F.col("previsto") == 1))
    return out.groupBy("target").agg(F.count("*").alias("linhas"), F.count_if(wrong).alias("incoerentes"))


@register("forest_search", "M-12")
def _(s, d):
    return M.tune_rf(_labelled(s, d).where("split = 'train'"))


def _cluster_features(s, d):
    share = FE.user_genre_share(B.sessions(s, d), B.games(s, d), B.game_categories(s, d))
    stats = FE.user_engagement(B.sessions(s, d)).drop("primeira_sessao").na.fill(0.0)
    out = share.join(stats, "usuario_id")
    return out.toDF(*[c.replace("#", "_").replace(".", "_") for c in out.columns])


@register("user_components", "M-05")
def _(s, d):
    from pyspark.ml.functions import vector_to_array

    points, _model = M.pca_95(_cluster_features(s, d), "usuario_id")
    return points.select("usuario_id", vector_to_array("features").alias("componentes"))


@register("user_components_share", "M-05", with_views("""
    SELECT count(DISTINCT usuario_id) AS usuarios, true AS bastam, true AS nenhum_a_mais FROM sessions""", "sessions"))
def _(s, d):
    """One point per user; the components kept hold 95 % of the variance, one less would not."""
    from pyspark.ml.functions import vector_to_array

    points, model = M.pca_95(_cluster_features(s, d), "usuario_id")
    shares = F.array(*[F.lit(float(x)) for x in model.stages[2].explainedVariance.toArray()])
    total = lambda n: F.aggregate(F.slice(shares, 1, n), F.lit(0.0), lambda a, x: a + x)
    out = points.agg(F.count("*").alias("usuarios"), F.max(F.size(vector_to_array("features"))).alias("k"))
    return out.select("usuarios", (total(F.col("k")) >= 0.95).alias("bastam"), (total(F.col("k") - 1) < 0.95).alias("nenhum_a_mais"))


@register("user_clusters", "M-06 M-05 F-03 F-04")
def _(s, d):
    return M.user_clusters(_cluster_features(s, d))[0]


@register("svd_item_vectors", "M-08 M-07")
def _(s, d):
    _users, items, _s = K.train_svd(FE.interactions(B.sessions(s, d)), k=50)
    return items


@register("svd_orthonormal", "M-08", with_views("""
    SELECT count(DISTINCT jogo_id) AS itens, 10::BIGINT AS eixos, 0.0::DOUBLE AS desvio FROM sessions""", "sessions"))
def _(s, d):
    """Item vectors: one for each played item, and their axes have length 1 and right angles."""
    _users, items, _s = K.train_svd(FE.interactions(B.sessions(s, d)), k=10)
    apart = K.axis_deviation(items)
    return items.agg(F.count("*").alias("itens"), F.max(F.size("vetor")).cast("bigint").alias("eixos"), F.round(F.lit(apart) + 0.0, 6).alias("desvio"))


@register("svd_explained_variance", "M-08")
def _(s, d):
    edges = FE.interactions(B.sessions(s, d))
    users, _items, _s = K.train_svd(edges, k=50)
    return K.explained_variance(edges, users, B.users(s, d).count())


def _condition(s, d):
    clusters, k, _score = M.user_clusters(_cluster_features(s, d))
    out = FE.user_condition(B.sessions(s, d), B.games(s, d), B.game_categories(s, d), B.users(s, d), B.as_of(), clusters, k)
    return out.toDF(*[c.replace("#", "_") for c in out.columns])


@register("user_condition", "F-08 J-09")
def _(s, d):
    return _condition(s, d)


def _threshold_rows(s, d):
    known = B.emb_users(s, d).withColumnRenamed("id", "usuario_id")
    targets = R.best_thresholds(known, B.emb_items(s, d), R.holdout_latest(B.sessions(s, d)))
    return M.threshold_dataset(_condition(s, d), targets)


@register("threshold_dataset", "M-10 O-08 J-08")
def _(s, d):
    return _threshold_rows(s, d)


@register("threshold_split_sizes", "M-10 O-08", with_views(f"""
    SELECT best_threshold, count(*) AS linhas, round(count(*) * 0.2::DOUBLE)::BIGINT AS teste,
           round((count(*) - round(count(*) * 0.2::DOUBLE)) * 0.125::DOUBLE)::BIGINT AS validacao
    FROM ({R_QUERIES.BEST}) AS alvo JOIN users ON users.id = alvo.usuario_id GROUP BY best_threshold""", "emb_users", "emb_items", "sessions", "users"))
def _(s, d):
    """Rows of the training set by best threshold, and how many of them are held out for test and validation."""
    known = B.emb_users(s, d).withColumnRenamed("id", "usuario_id")
    targets = R.best_thresholds(known, B.emb_items(s, d), R.holdout_latest(B.sessions(s, d)))
    condition = FE.user_condition(B.sessions(s, d), B.games(s, d), B.game_categories(s, d), B.users(s, d), B.as_of())
    rows = M.threshold_dataset(condition, targets)
    return rows.groupBy("best_threshold").agg(
        F.count("*").alias("linhas"), F.count_if(F.col("split") == "test").alias("teste"), F.count_if(F.col("split") == "val").alias("validacao"))


@register("threshold_model", "M-11")
def _(s, d):
    from acervo.session import cut_lineage

    rows = cut_lineage(_threshold_rows(s, d))
    return M.predict_threshold(M.train_threshold_model(rows.where("split = 'train'")), rows)


@register("threshold_generator", "M-11")
def _(s, d):
    """Mean absolute error of the conditional generator beside that of the boosted trees, by split."""
    from acervo.session import cut_lineage

    rows = cut_lineage(_threshold_rows(s, d))
    train = rows.where("split = 'train'")
    drawn = M.threshold_error(G.generate_threshold(G.train_generator(train), rows)).withColumn("modelo", F.lit("gerador"))
    trees = M.threshold_error(M.predict_threshold(M.train_threshold_model(train), rows)).withColumn("modelo", F.lit("arvores"))
    return drawn.unionByName(trees)


@register("user_clusters_shape", "M-06", with_views("""
    SELECT count(DISTINCT usuario_id) AS usuarios, true AS grupos_no_intervalo, true AS silhueta_no_intervalo FROM sessions""", "sessions"))
def _(s, d):
    """Every user is in one cluster, of 3 to 10, and the silhouette of the choice lies between -1 and 1."""
    clusters, k, score = M.user_clusters(_cluster_features(s, d))
    out = clusters.agg(F.count("*").alias("usuarios"), F.count_distinct("cluster").alias("grupos"))
    return out.select("usuarios", F.col("grupos").between(3, k).alias("grupos_no_intervalo"), F.lit(k <= 10 and -1.0 <= score <= 1.0).alias("silhueta_no_intervalo"))


@register("cascade_by_rating", "R-08", with_views(R_QUERIES.LISTS + f"""
    SELECT lists.usuario_id, lists.rank::INT AS rank, lists.item, c.cluster
    FROM lists LEFT JOIN (SELECT usuario_id * 2 AS usuario_id, usuario_id % 3 AS cluster FROM emb_requests) c USING (usuario_id) WHERE modo = 'equilibrado' AND item IN (SELECT id FROM games WHERE avaliacao_media >= {GOOD})""", *R_QUERIES.VIEWS, "games"))
def _(s, d):
    """The cascade with games of a good rating for those predicted good; archetypes under twice the users' ids, so that odd ones have none."""
    good = FE.good_game_label(B.games(s, d), GOOD).where("target = 1").select(F.col("id").alias("item"))
    lists = R.recommend(R.with_cold_start(B.emb_requests(s, d), B.emb_users(s, d)), B.emb_items(s, d), 10)
    clusters = B.emb_requests(s, d).select((F.col("usuario_id") * 2).alias("usuario_id"), (F.col("usuario_id") % 3).alias("cluster"))
    return R.cascade(lists, good, clusters).select("usuario_id", "rank", "item", "cluster")


@register("cascade", "R-08")
def _(s, d):
    rows = _labelled(s, d)
    model = M.train_quality_rf(rows.where("split = 'train'"))
    good = M.predict_quality(model, rows).where("previsto = 1").select(F.col("id").alias("item"))
    clusters = M.user_clusters(_cluster_features(s, d))[0]
    lists = R.recommend(B.emb_users(s, d).withColumnRenamed("id", "usuario_id"), B.emb_items(s, d), 10)
    return R.cascade(lists, good, clusters)


def _stream(s, d):
    schema = B.table(s, d, "events").schema
    return B.session_events(ST.event_stream(s, d, "events.parquet", schema))


@register("stream_ingest", "ST-01 S-11", with_views("""
    SELECT usuario_id, jogo_id, inicio, fim, 'PC' AS plataforma FROM session_stream WHERE minutos > 0""", "session_stream"))
def _(s, d):
    path, checkpoint = ST.fresh_paths(s, "ingest")
    ST.ingest_sessions(_stream(s, d).drop("inicio"), path, checkpoint).awaitTermination()
    return s.read.parquet(path)


def _trend_sql(days: int) -> str:
    """Day-aligned windows of ``days`` starting every day, closed before the last day of the stream."""
    return with_views(f"""
    SELECT inicio, inicio + to_days({days}) AS fim, jogo_id, count(*) AS acessos FROM (
      SELECT jogo_id, date_trunc('day', fim) - to_days(i::INT) AS inicio FROM session_stream, range(0, {days}) AS w(i))
    WHERE inicio + to_days({days}) <= (SELECT max(fim) - INTERVAL 1 DAY FROM session_stream)
    GROUP BY 1, 2, 3""", "session_stream")


@register("stream_trending_daily", "ST-02", _trend_sql(1))
def _(s, d):
    path, checkpoint = ST.fresh_paths(s, "daily")
    ST.run_append(ST.trending_stream(_stream(s, d), 1, 1), path, checkpoint)
    return s.read.parquet(path)


@register("stream_trending_sliding", "ST-02", _trend_sql(7))
def _(s, d):
    path, checkpoint = ST.fresh_paths(s, "sliding")
    ST.run_append(ST.trending_stream(_stream(s, d), 7, 1), path, checkpoint)
    return s.read.parquet(path)


@register("stream_engagement", "ST-03 S-08", with_views("""
    SELECT usuario_id, count(*) AS sessoes, round(sum(minutos), 4) AS minutos, max(fim) AS ultima_sessao FROM session_stream GROUP BY 1""", "session_stream"))
def _(s, d):
    _path, checkpoint = ST.fresh_paths(s, "engagement")
    ST.run_engagement(_stream(s, d), checkpoint)
    return ST.current_engagement(s, checkpoint).withColumn("minutos", r("minutos", 4))
