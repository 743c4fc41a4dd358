"""Per-user reports, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def user_library(library: DataFrame, games: DataFrame, sessions: DataFrame) -> DataFrame:
    """Owned games with total hours (0 without sessions) and the last session."""
    played = sessions.groupBy("usuario_id", "jogo_id").agg(
        F.sum("horas_jogadas").alias("h"), F.max("fim").alias("ultima_sessao")
    )
    owned = library.join(played, ["usuario_id", "jogo_id"], "left")
    facts = games.select(F.col("id").alias("jogo_id"), "titulo", "preco_base", "avaliacao_media")
    return owned.join(facts, "jogo_id").select(
        "usuario_id",
        "jogo_id",
        "titulo",
        "preco_base",
        "avaliacao_media",
        F.coalesce("h", F.lit(0.0)).alias("horas_jogadas"),
        "ultima_sessao",
    )


def played_games(sessions: DataFrame, games: DataFrame) -> DataFrame:
    """Games each user played with total hours."""
    hours = sessions.groupBy("usuario_id", F.col("jogo_id").alias("id")).agg(
        F.sum(F.coalesce("horas_jogadas", F.lit(0.0))).alias("total_horas")
    )
    facts = games.select("id", "titulo", "preco_base", "avaliacao_media")
    return hours.join(facts, "id")


def favourite_category(library: DataFrame, bridge: DataFrame) -> DataFrame:
    """The category most frequent among a user's games; ties go to the first name."""
    owned = library.select("usuario_id", "jogo_id").distinct()
    counts = owned.join(bridge, "jogo_id").groupBy("usuario_id", "nome").agg(F.count("*").alias("n"))
    return counts.groupBy("usuario_id").agg(
        F.min_by("nome", F.struct(-F.col("n"), F.col("nome"))).alias("categoria_preferida")
    )


def user_stats(users: DataFrame, library: DataFrame, sessions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Owned games, hours and favourite category of every user."""
    owned = library.groupBy("usuario_id").agg(F.count("*").alias("n"))
    hours = sessions.groupBy("usuario_id").agg(F.sum("horas_jogadas").alias("h"))
    return (
        users.select(F.col("id").alias("usuario_id"))
        .join(owned, "usuario_id", "left")
        .join(hours, "usuario_id", "left")
        .join(favourite_category(library, bridge), "usuario_id", "left")
        .select(
            "usuario_id",
            F.coalesce("n", F.lit(0)).alias("total_jogos"),
            F.coalesce("h", F.lit(0.0)).alias("total_horas"),
            "categoria_preferida",
        )
    )


def user_stats_sessions(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct games played and hours; the favourite category stays open."""
    stats = sessions.groupBy("usuario_id").agg(
        F.count_distinct("jogo_id").alias("n"), F.sum("horas_jogadas").alias("h")
    )
    return (
        users.select(F.col("id").alias("usuario_id"))
        .join(stats, "usuario_id", "left")
        .select(
            "usuario_id",
            F.coalesce("n", F.lit(0)).alias("total_jogos"),
            F.coalesce("h", F.lit(0.0)).alias("total_horas"),
            F.lit(None).cast("string").alias("categoria_preferida"),
        )
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    """Sessions, active users and sessions per active user."""
    return sessions.agg(
        F.count("*").alias("total_sessoes"), F.count_distinct("usuario_id").alias("usuarios")
    ).withColumn("sessoes_por_usuario", F.try_divide("total_sessoes", "usuarios"))
