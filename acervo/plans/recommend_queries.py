"""Registered recommendation queries on the embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions.scalars import dot
from acervo.operators import evaluate as E, recommend as R
from acervo.plans import bindings as B
from acervo.plans.bindings import with_views
from acervo.plans.market_queries import r
from acervo.plans.registry import register

MODES_SQL = """modes AS (SELECT * FROM (VALUES ('conservador', 0.7::DOUBLE, 1, 9), ('equilibrado', 0.5::DOUBLE, 2, 8),
    ('aventureiro', 0.3::DOUBLE, 3, 7)) AS t(modo, threshold, n_explore, n_top))"""
MEAN = "mv AS (SELECT list(m ORDER BY pos) AS media FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(vetor) AS x, generate_subscripts(vetor, 1) AS pos FROM emb_users) GROUP BY pos))"
REQ = """req AS (SELECT q.usuario_id, coalesce(u.vetor, media) AS vetor,
    CASE WHEN u.id IS NULL THEN 'Jogo popular recomendado para novos usuários' ELSE 'Baseado no seu perfil de jogo' END AS explicacao
    FROM emb_requests q LEFT JOIN emb_users u ON u.id = q.usuario_id, mv)"""
SCORES = """qd AS (SELECT *, 1 + ('0x' || left(md5(CAST(usuario_id AS VARCHAR) || ':42'), 15))::BIGINT % 2147483646 AS f, ('0x' || left(md5(CAST(usuario_id AS VARCHAR) || ':43'), 15))::BIGINT % 2147483647 AS o FROM req),
    xd AS (SELECT *, ('0x' || left(md5(CAST(id AS VARCHAR) || ':44'), 15))::BIGINT % 2147483647 AS x FROM emb_items),
    sc AS (SELECT q.usuario_id, i.id AS item, list_dot_product(q.vetor, i.vetor) AS score, (f * x + o) % 2147483647 AS sorteio FROM qd q, xd i)"""
LISTS = f"""WITH {MEAN}, {REQ}, {SCORES}, {MODES_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY usuario_id ORDER BY score DESC, item) AS place FROM sc),
nv AS (SELECT usuario_id, modo, threshold, n_explore, n_top, count(*) FILTER (WHERE score >= threshold) AS n FROM sc, modes GROUP BY ALL),
va AS (SELECT usuario_id, modo, item, score, sorteio, place, n_explore, n_top, CASE WHEN n = 0 THEN 20 ELSE n END AS n
       FROM rk JOIN nv USING (usuario_id) WHERE score >= threshold OR (n = 0 AND place <= 20)),
ex AS (SELECT *, row_number() OVER (PARTITION BY usuario_id, modo ORDER BY sorteio, item) AS o FROM va WHERE place > n_top AND n > n_top),
li AS (SELECT usuario_id, modo, item, score, 'topo' AS origem, place AS o FROM va WHERE place <= n_top
       UNION ALL SELECT usuario_id, modo, item, score, 'exploracao', o FROM ex WHERE o <= n_explore),
lists AS (SELECT usuario_id, modo, item, score, origem,
          row_number() OVER (PARTITION BY usuario_id, modo ORDER BY origem DESC, o) AS rank FROM li)
"""
VIEWS = ("emb_users", "emb_items", "emb_requests")


def _requests(s, d):
    return R.with_cold_start(B.emb_requests(s, d), B.emb_users(s, d))


def _known(s, d):
    return B.emb_users(s, d).withColumnRenamed("id", "usuario_id")


def _lists(s, d):
    return R.recommend_modes(_requests(s, d), B.emb_items(s, d), 10)


@register("similar_games", "R-01 J-10 J-04 P-05", with_views("""
    SELECT jogo_id, rank::INT AS rank, similar_id, categorias_comuns FROM (
      SELECT a.jogo_id, b.jogo_id AS similar_id, count(DISTINCT b.nome) AS categorias_comuns,
             row_number() OVER (PARTITION BY a.jogo_id ORDER BY count(DISTINCT b.nome) DESC, any_value(avaliacao_media) DESC, b.jogo_id) AS rank
      FROM game_categories a JOIN game_categories b ON a.nome = b.nome AND a.jogo_id <> b.jogo_id
      JOIN games ON games.id = b.jogo_id GROUP BY 1, 2) WHERE rank <= 10""", "games", "game_categories"))
def _(s, d):
    return R.similar_games(B.games(s, d), B.game_categories(s, d), 10)


@register("user_cold_start", "R-04", with_views(f"""WITH {MEAN}, {REQ}
    SELECT usuario_id, explicacao, round(vetor[1], 6) AS v1, round(list_sum(vetor), 6) AS total FROM req""", *VIEWS))
def _(s, d):
    total = F.aggregate("vetor", F.lit(0.0), lambda a, x: a + x)
    return _requests(s, d).select("usuario_id", "explicacao", F.round(F.col("vetor")[0], 6).alias("v1"), F.round(total, 6).alias("total"))


@register("item_mean_score", "X-26 R-04", with_views(f"""WITH {MEAN}
    SELECT id, round(list_dot_product(vetor, media), 6) AS score FROM emb_items, mv""", *VIEWS))
def _(s, d):
    out = B.emb_items(s, d).join(F.broadcast(R.mean_vector(B.emb_users(s, d))))
    return out.select("id", F.round(dot(F.col("vetor"), F.col("media")), 6).alias("score"))


@register("score_summary", "R-03 J-07", with_views("""
    SELECT u.id AS usuario_id, count(*) AS n_itens, round(min(list_dot_product(u.vetor, i.vetor)), 6) AS menor,
           round(max(list_dot_product(u.vetor, i.vetor)), 6) AS maior, round(avg(list_dot_product(u.vetor, i.vetor)), 6) AS media,
           count(*) FILTER (WHERE list_dot_product(u.vetor, i.vetor) >= 0.7) AS n_70,
           count(*) FILTER (WHERE list_dot_product(u.vetor, i.vetor) >= 0.5) AS n_50,
           count(*) FILTER (WHERE list_dot_product(u.vetor, i.vetor) >= 0.3) AS n_30
    FROM emb_users u, emb_items i GROUP BY 1""", *VIEWS))
def _(s, d):
    out = R.score_summary(_known(s, d), B.emb_items(s, d))
    return out.select("usuario_id", "n_itens", r("menor"), r("maior"), r("media"), "n_70", "n_50", "n_30")


@register("top_items", "W-01 R-03 J-07", with_views("""
    SELECT u.id AS usuario_id, i.id AS item, round(list_dot_product(u.vetor, i.vetor), 6) AS score,
           row_number() OVER (PARTITION BY u.id ORDER BY list_dot_product(u.vetor, i.vetor) DESC, i.id)::INT AS rank
    FROM emb_users u, emb_items i QUALIFY rank <= 10""", *VIEWS))
def _(s, d):
    return R.top_items(_known(s, d), B.emb_items(s, d), 10).select("usuario_id", "item", r("score"), "rank")


@register("threshold_relaxed", "R-05", with_views("""
    WITH sc AS (SELECT u.id AS usuario_id, i.id AS item, list_dot_product(u.vetor, i.vetor) / 3 AS score,
                row_number() OVER (PARTITION BY u.id ORDER BY list_dot_product(u.vetor, i.vetor) / 3 DESC, i.id) AS rank
                FROM emb_users u, emb_items i),
    b AS (SELECT *, max(score) OVER (PARTITION BY usuario_id) AS best FROM sc)
    SELECT usuario_id, item, round(score, 6) AS score FROM b WHERE score >= 0.35 OR (best < 0.35 AND rank <= 10)""", *VIEWS))
def _(s, d):
    third = F.transform("vetor", lambda x: x / 3)
    return R.items_above(_known(s, d).withColumn("vetor", third), B.emb_items(s, d), 0.35, 5).select("usuario_id", "item", r("score"))


@register("threshold_lists", "R-05", with_views("""
    WITH sc AS (SELECT u.id AS usuario_id, i.id AS item, list_dot_product(u.vetor, i.vetor) / 3 AS score,
                row_number() OVER (PARTITION BY u.id ORDER BY list_dot_product(u.vetor, i.vetor) / 3 DESC, i.id) AS rank
                FROM emb_users u, emb_items i),
    b AS (SELECT *, count(*) FILTER (WHERE score >= 0.35) OVER (PARTITION BY usuario_id) AS n_valid FROM sc)
    SELECT usuario_id, rank::INT AS rank, item, round(score, 6) AS score, n_valid FROM b
    WHERE (score >= 0.35 AND rank <= 20) OR (n_valid = 0 AND rank <= 10)""", *VIEWS))
def _(s, d):
    third = F.transform("vetor", lambda x: x / 3)
    return R.threshold_lists(_known(s, d).withColumn("vetor", third), B.emb_items(s, d), 0.35, 5, 20).withColumn("score", r("score"))


@register("recommendations", "R-06 R-02 R-04 R-05 W-01 O-09", with_views(
    LISTS + "SELECT usuario_id, modo, rank::INT AS rank, item, round(score, 6) AS score, origem FROM lists", *VIEWS))
def _(s, d):
    return _lists(s, d).withColumn("score", r("score"))


@register("recommendations_balanced", "R-06 R-02", with_views(
    LISTS + "SELECT usuario_id, rank::INT AS rank, item, round(score, 6) AS score FROM lists WHERE modo = 'equilibrado'", *VIEWS))
def _(s, d):
    return R.recommend(_requests(s, d), B.emb_items(s, d), 10).select("usuario_id", "rank", "item", r("score"))


@register("mode_table", "R-02", with_views(f"""
    WITH {MODES_SQL} SELECT modo, threshold, n_explore, n_top, (SELECT count(*) FROM emb_users) AS usuarios FROM modes""", "emb_users"))
def _(s, d):
    n = B.emb_users(s, d).agg(F.count("*").alias("usuarios"))
    return R.mode_table(s, 10).drop("exploracao").join(F.broadcast(n))


@register("mode_report", "E-08", with_views(LISTS + """
    SELECT modo, count(DISTINCT item) AS unicos, round(count(DISTINCT item) * 100.0::DOUBLE / (SELECT count(*) FROM emb_items), 6) AS pct,
           round(avg(score), 6) AS score_medio FROM lists GROUP BY modo""", *VIEWS))
def _(s, d):
    out = E.mode_report(_lists(s, d), B.emb_items(s, d).withColumnRenamed("id", "item"))
    return out.select("modo", "unicos", r("pct"), r("score_medio"))


@register("mode_overlap", "U-04", with_views(LISTS + """
    SELECT a.usuario_id, count(b.item) AS em_comum FROM (SELECT * FROM lists WHERE modo = 'conservador') a
    LEFT JOIN (SELECT * FROM lists WHERE modo = 'aventureiro') b ON a.usuario_id = b.usuario_id AND a.item = b.item
    GROUP BY 1""", *VIEWS))
def _(s, d):
    lists = _lists(s, d)
    return E.mode_overlap(lists.where("modo = 'conservador'"), lists.where("modo = 'aventureiro'"))


@register("popular_items", "R-07", with_views(
    "SELECT jogo_id AS item, count(*) AS acessos FROM sessions GROUP BY 1 ORDER BY acessos DESC, item LIMIT 10", "sessions"))
def _(s, d):
    return R.popular_items(B.sessions(s, d), 10)


HOLD = """hold AS (SELECT DISTINCT usuario_id, jogo_id AS item FROM (
    SELECT *, row_number() OVER (PARTITION BY usuario_id ORDER BY inicio DESC, jogo_id DESC) AS i,
           count(*) OVER (PARTITION BY usuario_id) AS n FROM sessions) WHERE i <= greatest(1, floor(n * 0.2::DOUBLE)))"""


@register("holdout_latest", "W-02", with_views(f"WITH {HOLD} SELECT usuario_id, item FROM hold", "sessions"))
def _(s, d):
    return R.holdout_latest(B.sessions(s, d))


BEST = f"""WITH {HOLD},
    sc AS (SELECT u.id AS usuario_id, i.id AS item, list_dot_product(u.vetor, i.vetor) AS s FROM emb_users u, emb_items i),
    nm AS (SELECT usuario_id, item, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS s FROM sc WINDOW w AS (PARTITION BY usuario_id)),
    tt AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS t),
    pk AS (SELECT usuario_id, t, item FROM nm, tt WHERE s >= t
           QUALIFY row_number() OVER (PARTITION BY usuario_id, t ORDER BY s DESC, item) <= 10),
    pr AS (SELECT p.usuario_id, t, avg((h.item IS NOT NULL)::INT) AS p FROM pk p
           LEFT JOIN hold h ON h.usuario_id = p.usuario_id AND h.item = p.item GROUP BY 1, 2)
    SELECT usuario_id, t AS best_threshold, round(p, 6) AS best_precision FROM pr
    WHERE usuario_id IN (SELECT usuario_id FROM hold)
    QUALIFY row_number() OVER (PARTITION BY usuario_id ORDER BY p DESC, t) = 1"""


@register("best_thresholds", "M-09", with_views(BEST, "emb_users", "emb_items", "sessions"))
def _(s, d):
    out = R.best_thresholds(_known(s, d), B.emb_items(s, d), R.holdout_latest(B.sessions(s, d)))
    return out.select("usuario_id", "best_threshold", r("best_precision"))
