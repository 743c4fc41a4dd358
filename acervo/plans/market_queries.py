"""Registered catalogue, market and user queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import market as M, players as P
from acervo.plans import bindings as B
from acervo.plans.bindings import AS_OF, with_views
from acervo.plans.registry import register

GENRES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
GENRES_SQL = ", ".join(f"'{g}'" for g in GENRES)


def r(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


@register("list_games", "P-01a O-03", with_views("""
    SELECT id, titulo, preco_base, round(avaliacao_media, 6) AS avaliacao_media, total_avaliacoes, idade_requerida
    FROM games ORDER BY id LIMIT 50 OFFSET 20""", "games"))
def _(s, d):
    out = M.list_games(B.games(s, d), 50, 20)
    return out.withColumn("avaliacao_media", r("avaliacao_media"))


@register("games_by_category_pattern", "P-02a J-01 O-01 O-03", with_views("""
    SELECT id, titulo, preco_base, round(avaliacao_media, 6) AS avaliacao_media
    FROM games JOIN game_categories ON id = jogo_id WHERE nome ILIKE 'eco%'
    ORDER BY games.avaliacao_media DESC, id, nome LIMIT 20 OFFSET 5""", "games", "game_categories"))
def _(s, d):
    out = M.games_by_category(B.games(s, d), B.game_categories(s, d), "eco%", 20, 5)
    return out.select("id", "titulo", "preco_base", r("avaliacao_media"))


@register("games_by_category_exact", "P-02b J-01", with_views("""
    SELECT id, titulo, preco_base, round(avaliacao_media, 6) AS avaliacao_media, total_avaliacoes
    FROM games JOIN game_categories ON id = jogo_id WHERE nome = 'PROMO' ORDER BY id LIMIT 40""",
    "games", "game_categories"))
def _(s, d):
    out = M.games_by_category(B.games(s, d), B.game_categories(s, d), "PROMO", 40, exact=True)
    return out.withColumn("avaliacao_media", r("avaliacao_media"))


@register("game_by_id", "P-03", with_views(
    "SELECT id, titulo, preco_base, desenvolvedor_id, data_lancamento FROM games WHERE id = 17", "games"))
def _(s, d):
    out = M.game_by_id(B.games(s, d), 17)
    return out.select("id", "titulo", "preco_base", "desenvolvedor_id", "data_lancamento")


@register("game_details", "J-02 A-05", with_views("""
    SELECT g.id, titulo, desenvolvedor_id, nome AS desenvolvedor_nome, pais AS desenvolvedor_pais, categorias
    FROM games g LEFT JOIN developers d ON desenvolvedor_id = d.id
    LEFT JOIN (SELECT jogo_id, string_agg(nome, '|' ORDER BY nome) AS categorias
               FROM game_categories GROUP BY 1) ON jogo_id = g.id""",
    "games", "developers", "game_categories"))
def _(s, d):
    out = M.game_details(B.games(s, d), B.developers(s, d), B.game_categories(s, d))
    return out.select("id", "titulo", "desenvolvedor_id", "desenvolvedor_nome", "desenvolvedor_pais",
                      F.array_join("categorias", "|").alias("categorias"))


@register("achievement_tier", "P-14", with_views("""
    SELECT g.id, count(a.jogo_id) AS achievements,
           CASE WHEN count(a.jogo_id) <= 1 THEN 'baixo' WHEN count(a.jogo_id) <= 3 THEN 'médio'
                WHEN count(a.jogo_id) <= 5 THEN 'alto' ELSE 'extremo' END AS tier
    FROM games g LEFT JOIN achievements a ON a.jogo_id = g.id GROUP BY g.id""", "games", "achievements"))
def _(s, d):
    return M.achievement_tier(B.games(s, d), B.achievements(s, d))


@register("adjusted_rating", "P-15", with_views("""
    SELECT id, round(avaliacao_media, 6) AS nota_original,
           round(greatest(0, least(10, avaliacao_media + CASE WHEN preco_base > 50 THEN -0.5::DOUBLE ELSE 0 END)), 6) AS nota_ajustada,
           CASE WHEN preco_base > 50 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS fator_preco FROM games""", "games"))
def _(s, d):
    return M.adjusted_rating(B.games(s, d)).select("id", r("nota_original"), r("nota_ajustada"), "fator_preco")


@register("validation_counts", "P-16", with_views("""
    SELECT count(*) FILTER (WHERE coalesce("Price" < 0, TRUE)) AS bad_price,
           count(*) FILTER (WHERE coalesce("AppID" <= 0, TRUE)) AS bad_id,
           count(*) FILTER (WHERE "Price" >= 0 AND "AppID" > 0) AS ok FROM catalog""", "catalog"))
def _(s, d):
    c = B.catalog(s, d).select(F.col("AppID").alias("id"), F.col("Price").alias("preco_base"))
    return M.validation_counts(c)


@register("valid_rows", "P-16 P-12", with_views("""
    SELECT "AppID" AS id, round("Price", 6) AS preco_base FROM catalog WHERE "Price" >= 0 AND "AppID" > 0""", "catalog"))
def _(s, d):
    c = B.catalog(s, d).select(F.col("AppID").alias("id"), F.col("Price").alias("preco_base"))
    return M.validate_rows(c)[0].select("id", r("preco_base"))


@register("recent_sessions", "P-06", with_views(f"""
    SELECT usuario_id, jogo_id, inicio, fim, horas_jogadas FROM sessions
    WHERE fim > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""", "sessions"))
def _(s, d):
    return M.recent(B.sessions(s, d), B.as_of(), 30)


@register("trending", "A-04 P-06 O-01", with_views(f"""
    SELECT id, titulo, count(*) AS acessos FROM sessions JOIN games ON jogo_id = id
    WHERE fim > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
    GROUP BY id, titulo ORDER BY acessos DESC, id LIMIT 10""", "sessions", "games"))
def _(s, d):
    return M.trending(B.sessions(s, d), B.games(s, d), B.as_of(), 30)


@register("price_by_category", "A-01a J-01", with_views("""
    SELECT nome, round(avg(preco_base), 6) AS preco_medio, round(stddev_samp(preco_base), 6) AS desvio_padrao,
           count(id) AS total_jogos FROM games JOIN game_categories ON id = jogo_id GROUP BY nome""",
    "games", "game_categories"))
def _(s, d):
    out = M.price_by_category(B.games(s, d), B.game_categories(s, d))
    return out.select("nome", r("preco_medio"), r("desvio_padrao"), "total_jogos")


@register("price_by_category_top", "A-01b X-25", with_views("""
    SELECT nome AS categoria, round(avg(preco_base)::DECIMAL(38,10), 2)::DOUBLE AS preco_medio
    FROM games JOIN game_categories ON id = jogo_id GROUP BY nome ORDER BY preco_medio DESC, categoria LIMIT 20""",
    "games", "game_categories"))
def _(s, d):
    return M.price_by_category(B.games(s, d), B.game_categories(s, d), top=20)


@register("playtime_by_genre", "A-02a P-04 J-01", with_views(f"""
    SELECT nome AS genero, round(quantile_cont(horas_jogadas, 0.5), 6) AS mediana_horas,
           round(avg(horas_jogadas), 6) AS media_horas, count(DISTINCT usuario_id) AS total_jogadores
    FROM sessions JOIN game_categories USING (jogo_id) WHERE nome IN ({GENRES_SQL}) GROUP BY nome""",
    "sessions", "game_categories"))
def _(s, d):
    out = M.playtime_by_genre(B.sessions(s, d), B.game_categories(s, d), GENRES)
    return out.select("genero", r("mediana_horas"), r("media_horas"), "total_jogadores")


@register("playtime_by_category", "A-02b", with_views("""
    SELECT nome AS genero, round((sum(coalesce(horas_jogadas, 0)) / count(*))::DECIMAL(38,10), 2)::DOUBLE AS media_horas
    FROM sessions JOIN game_categories USING (jogo_id) GROUP BY nome ORDER BY media_horas DESC, genero LIMIT 20""",
    "sessions", "game_categories"))
def _(s, d):
    return M.playtime_by_category(B.sessions(s, d), B.game_categories(s, d))


@register("top_developers", "A-03a O-01", with_views("""
    SELECT d.id, d.nome, round(avg(avaliacao_media), 6) AS nota_media,
           round(stddev_samp(avaliacao_media), 6) AS consistencia, count(g.id) AS total_jogos
    FROM developers d JOIN games g ON d.id = desenvolvedor_id GROUP BY d.id, d.nome HAVING count(g.id) >= 5
    ORDER BY avg(avaliacao_media) DESC, d.id LIMIT 10""", "developers", "games"))
def _(s, d):
    out = M.top_developers(B.games(s, d), B.developers(s, d))
    return out.select("id", "nome", r("nota_media"), r("consistencia"), "total_jogos")


@register("top_developer_names", "A-03b", with_views("""
    SELECT nome AS desenvolvedor, round(avg(avaliacao_media)::DECIMAL(38,10), 2)::DOUBLE AS media_avaliacao,
           count(g.id) AS total_jogos
    FROM developers d JOIN games g ON d.id = desenvolvedor_id GROUP BY nome HAVING count(g.id) >= 3
    ORDER BY media_avaliacao DESC, desenvolvedor LIMIT 10""", "developers", "games"))
def _(s, d):
    return M.top_developer_names(B.games(s, d), B.developers(s, d))


@register("user_library", "A-06 J-03", with_views("""
    SELECT b.usuario_id, b.jogo_id, titulo, preco_base, round(avaliacao_media, 6) AS avaliacao_media,
           coalesce(sum(horas_jogadas), 0) AS horas_jogadas, max(fim) AS ultima_sessao
    FROM library b JOIN games ON b.jogo_id = id
    LEFT JOIN sessions s ON s.jogo_id = b.jogo_id AND s.usuario_id = b.usuario_id
    GROUP BY b.usuario_id, b.jogo_id, titulo, preco_base, avaliacao_media""", "library", "games", "sessions"))
def _(s, d):
    out = P.user_library(B.library(s, d), B.games(s, d), B.sessions(s, d))
    return out.withColumn("avaliacao_media", r("avaliacao_media"))


@register("played_games", "A-07 U-06", with_views("""
    SELECT DISTINCT usuario_id, id, titulo, preco_base, round(avaliacao_media, 6) AS avaliacao_media,
           sum(coalesce(horas_jogadas, 0)) AS total_horas
    FROM sessions JOIN games ON jogo_id = id GROUP BY usuario_id, id, titulo, preco_base, avaliacao_media""",
    "sessions", "games"))
def _(s, d):
    return P.played_games(B.sessions(s, d), B.games(s, d)).withColumn("avaliacao_media", r("avaliacao_media"))


@register("user_stats", "A-08a W-04 J-04", with_views("""
    SELECT u.id AS usuario_id, coalesce(total_jogos, 0) AS total_jogos, coalesce(h, 0) AS total_horas, categoria_preferida
    FROM users u
    LEFT JOIN (SELECT usuario_id, count(*) AS total_jogos FROM library GROUP BY 1) l ON l.usuario_id = u.id
    LEFT JOIN (SELECT usuario_id, sum(horas_jogadas) AS h FROM sessions GROUP BY 1) s ON s.usuario_id = u.id
    LEFT JOIN (SELECT usuario_id, nome AS categoria_preferida FROM (
                 SELECT usuario_id, nome, count(*) AS n FROM library JOIN game_categories USING (jogo_id) GROUP BY 1, 2)
               QUALIFY row_number() OVER (PARTITION BY usuario_id ORDER BY n DESC, nome) = 1) c ON c.usuario_id = u.id""",
    "users", "library", "sessions", "game_categories"))
def _(s, d):
    return P.user_stats(B.users(s, d), B.library(s, d), B.sessions(s, d), B.game_categories(s, d))


@register("user_stats_sessions", "A-08b", with_views("""
    SELECT u.id AS usuario_id, count(DISTINCT jogo_id) AS total_jogos,
           coalesce(sum(horas_jogadas), 0) AS total_horas, NULL::VARCHAR AS categoria_preferida
    FROM users u LEFT JOIN sessions s ON s.usuario_id = u.id GROUP BY u.id""", "users", "sessions"))
def _(s, d):
    return P.user_stats_sessions(B.users(s, d), B.sessions(s, d))


@register("session_summary", "A-09", with_views("""
    SELECT count(*) AS total_sessoes, count(DISTINCT usuario_id) AS usuarios,
           round(count(*) / count(DISTINCT usuario_id)::DOUBLE, 6) AS sessoes_por_usuario FROM sessions""", "sessions"))
def _(s, d):
    return P.session_summary(B.sessions(s, d)).withColumn("sessoes_por_usuario", r("sessoes_por_usuario"))
