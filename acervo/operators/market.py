"""Catalogue listings and market reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acervo.fixed_values import ACHIEVEMENT_TIERS, ACHIEVEMENT_TOP_TIER, PLAYTIME_GENRES
from acervo.functions.prefix import exact_quantiles
from acervo.functions.scalars import half_up


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def list_games(games: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    cols = ["id", "titulo", "preco_base", "avaliacao_media", "total_avaliacoes", "idade_requerida"]
    return page(games.select(*cols).orderBy("id"), limit, offset)


def games_with_categories(games: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per game and category."""
    return games.join(bridge, F.col("id") == F.col("jogo_id")).drop("jogo_id")


def games_by_category(
    games: DataFrame, bridge: DataFrame, name: str, limit: int = 50, offset: int = 0, exact: bool = False
) -> DataFrame:
    """Games of a category: exact name, or a case-insensitive pattern ranked by rating."""
    if exact:
        cols = ["id", "titulo", "preco_base", "avaliacao_media", "total_avaliacoes"]
        hits = games_with_categories(games, bridge.where(F.col("nome") == name))
        return page(hits.select(*cols).orderBy("id"), limit, offset)
    hits = games_with_categories(games, bridge.where(F.col("nome").ilike(name)))
    return page(hits.orderBy(F.desc("avaliacao_media"), "id", "nome").drop("nome"), limit, offset)


def game_by_id(games: DataFrame, game_id: int | str) -> DataFrame:
    return games.where(F.col("id") == F.lit(game_id))


def categories_per_game(bridge: DataFrame) -> DataFrame:
    """Sorted category names of each game."""
    return bridge.groupBy(F.col("jogo_id").alias("id")).agg(
        F.array_sort(F.collect_list("nome")).alias("categorias")
    )


def game_details(games: DataFrame, devs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Games with developer name, country and category list; games without them stay."""
    dev = devs.select(
        F.col("id").alias("desenvolvedor_id"),
        F.col("nome").alias("desenvolvedor_nome"),
        F.col("pais").alias("desenvolvedor_pais"),
    )
    return games.join(dev, "desenvolvedor_id", "left").join(categories_per_game(bridge), "id", "left")


def tier_of(count: Column) -> Column:
    out = None
    for bound, label in ACHIEVEMENT_TIERS:
        test = count <= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(ACHIEVEMENT_TOP_TIER)


def achievement_tier(games: DataFrame, achievements: DataFrame) -> DataFrame:
    """Achievement count and tier of every game; games without any count 0."""
    counts = achievements.groupBy(F.col("jogo_id").alias("id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return games.select("id").join(counts, "id", "left").select(
        "id", n.alias("achievements"), tier_of(n).alias("tier")
    )


def adjusted_rating(games: DataFrame, price_threshold: float = 50.0, null_as_zero: bool = True) -> DataFrame:
    """Half a point less above the price threshold, kept within 0..10."""
    price, rating = F.col("preco_base"), F.col("avaliacao_media")
    if null_as_zero:
        price, rating = F.coalesce(price, F.lit(0.0)), F.coalesce(rating, F.lit(0.0))
    factor = F.when(price > price_threshold, F.lit(-0.5)).otherwise(F.lit(0.0))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(10.0), rating + factor))
    return games.select(
        "id",
        rating.alias("nota_original"),
        F.when(rating.isNotNull(), moved).alias("nota_ajustada"),
        factor.alias("fator_preco"),
    )


def _row_ok() -> Column:
    return F.coalesce((F.col("preco_base") >= 0) & (F.col("id") > 0), F.lit(False))


def validate_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with price >= 0 and id > 0, and the others."""
    return df.where(_row_ok()), df.where(~_row_ok())


def validation_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.coalesce(F.col("preco_base") < 0, F.lit(True))).alias("bad_price"),
        F.count_if(F.coalesce(F.col("id") <= 0, F.lit(True))).alias("bad_id"),
        F.count_if(_row_ok()).alias("ok"),
    )


def recent(sessions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sessions that ended within ``days`` days before ``as_of``."""
    if not 1 <= days <= 365:
        raise ValueError("days must lie in 1..365")
    return sessions.where(F.col("fim") > as_of - F.make_dt_interval(days=F.lit(days)))


def trending(sessions: DataFrame, games: DataFrame, as_of: Column, days: int = 30, top: int = 10) -> DataFrame:
    hits = recent(sessions, as_of, days).groupBy(F.col("jogo_id").alias("id")).agg(
        F.count("*").alias("acessos")
    )
    return (
        games.select("id", "titulo").join(hits, "id").orderBy(F.desc("acessos"), "id").limit(top)
    )


def price_by_category(games: DataFrame, bridge: DataFrame, top: int | None = None) -> DataFrame:
    """Price per category: mean, deviation and count; or the rounded means of the ``top`` ones."""
    grouped = games_with_categories(games.select("id", "preco_base"), bridge).groupBy("nome")
    if top is None:
        return grouped.agg(
            F.avg("preco_base").alias("preco_medio"),
            F.stddev_samp("preco_base").alias("desvio_padrao"),
            F.count("id").alias("total_jogos"),
        ).orderBy(F.desc("preco_medio"), "nome")
    return (
        grouped.agg(half_up(F.avg("preco_base")).alias("preco_medio"))
        .withColumnRenamed("nome", "categoria")
        .orderBy(F.desc("preco_medio"), "categoria")
        .limit(top)
    )


def playtime_by_genre(
    sessions: DataFrame, bridge: DataFrame, genres: list[str] | None = None
) -> DataFrame:
    """Exact median, mean and distinct players per listed genre; null hours do not count."""
    genres = PLAYTIME_GENRES if genres is None else genres
    wanted = bridge.where(F.col("nome").isin(genres)).withColumnRenamed("nome", "genero")
    # sessions are folded per game before the join, so a hot game stays small
    hours = (
        sessions.groupBy("jogo_id", "horas_jogadas")
        .agg(F.count("*").alias("w"))
        .join(wanted, "jogo_id")
        .groupBy("genero", "horas_jogadas")
        .agg(F.sum("w").alias("w"))
    )
    known = F.when(F.col("horas_jogadas").isNotNull(), F.col("w"))
    means = hours.groupBy("genero").agg(
        (F.sum(F.col("horas_jogadas") * F.col("w")) / F.sum(known)).alias("media_horas")
    )
    medians = exact_quantiles(hours, "horas_jogadas", {"mediana_horas": 0.5}, ["genero"], "w")
    players = (
        sessions.select("jogo_id", "usuario_id")
        .distinct()
        .join(wanted, "jogo_id")
        .groupBy("genero")
        .agg(F.count_distinct("usuario_id").alias("total_jogadores"))
    )
    return (
        players.join(means, "genero", "left")
        .join(medians, "genero", "left")
        .select("genero", "mediana_horas", "media_horas", "total_jogadores")
        .orderBy(F.desc("mediana_horas"), "genero")
    )


def playtime_by_category(sessions: DataFrame, bridge: DataFrame, top: int = 20) -> DataFrame:
    """Rounded mean hours per category where null hours count as 0."""
    per_game = sessions.groupBy("jogo_id").agg(
        F.sum(F.coalesce("horas_jogadas", F.lit(0.0))).alias("h"), F.count("*").alias("n")
    )
    return (
        per_game.join(bridge, "jogo_id")
        .groupBy(F.col("nome").alias("genero"))
        .agg(half_up(F.sum("h") / F.sum("n")).alias("media_horas"))
        .orderBy(F.desc("media_horas"), "genero")
        .limit(top)
    )


def top_developers(games: DataFrame, devs: DataFrame, min_games: int = 5, top: int = 10) -> DataFrame:
    """Best mean rating among developers with enough games, with its deviation."""
    # folded per developer id first; the name is joined to one row per developer
    stats = games.groupBy("desenvolvedor_id").agg(
        F.avg("avaliacao_media").alias("nota_media"),
        F.stddev_samp("avaliacao_media").alias("consistencia"),
        F.count("id").alias("total_jogos"),
    )
    return (
        stats.where(F.col("total_jogos") >= min_games)
        .join(devs.select("id", "nome"), F.col("desenvolvedor_id") == F.col("id"))
        .select("id", "nome", "nota_media", "consistencia", "total_jogos")
        .orderBy(F.desc("nota_media"), "id")
        .limit(top)
    )


def top_developer_names(games: DataFrame, devs: DataFrame, min_games: int = 3, top: int = 10) -> DataFrame:
    """Like ``top_developers`` but by name, with the rounded mean."""
    per_id = games.groupBy("desenvolvedor_id").agg(
        F.sum("avaliacao_media").alias("s"),
        F.count("avaliacao_media").alias("c"),
        F.count("id").alias("n"),
    )
    return (
        per_id.join(devs.select("id", "nome"), F.col("desenvolvedor_id") == F.col("id"))
        .groupBy(F.col("nome").alias("desenvolvedor"))
        .agg(
            half_up(F.try_divide(F.sum("s"), F.sum("c"))).alias("media_avaliacao"),
            F.sum("n").alias("total_jogos"),
        )
        .where(F.col("total_jogos") >= min_games)
        .orderBy(F.desc("media_avaliacao"), "desenvolvedor")
        .limit(top)
    )
