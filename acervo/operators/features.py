"""Game, user and interaction features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acervo.fixed_values import DEFAULT_AGE_DAYS, GOOD_GAME_THRESHOLD
from acervo.functions.lookup import align_to
from acervo.functions.prefix import exact_quantiles
from acervo.functions.scalars import has_item, hour_cycle, whole_days
from acervo.operators.market import categories_per_game



def valid_sessions(sessions: DataFrame, users: DataFrame, games: DataFrame) -> DataFrame:
    """Sessions whose user and game both exist."""
    u = users.select(F.col("id").alias("usuario_id"))
    g = games.select(F.col("id").alias("jogo_id"))
    return sessions.join(u, "usuario_id", "left_semi").join(g, "jogo_id", "left_semi")


def good_game_label(games: DataFrame, threshold: float = GOOD_GAME_THRESHOLD) -> DataFrame:
    good = F.coalesce(F.col("avaliacao_media") >= threshold, F.lit(False))
    return games.withColumn("target", good.cast("int"))


def class_balance(games: DataFrame, threshold: float = GOOD_GAME_THRESHOLD) -> DataFrame:
    """Positives, negatives, share of positives and imbalance."""
    out = good_game_label(games, threshold).agg(
        F.sum("target").alias("positivos"), F.sum(1 - F.col("target")).alias("negativos")
    )
    return out.select(
        "positivos",
        "negativos",
        F.try_divide("positivos", F.col("positivos") + F.col("negativos")).alias("proporcao"),
        F.try_divide("positivos", "negativos").alias("desequilibrio"),
    )


def top_categories(bridge: DataFrame, n: int = 20) -> list[str]:
    """Names of the ``n`` most frequent categories."""
    counts = bridge.groupBy("nome").agg(F.count("*").alias("c"))
    return [r["nome"] for r in counts.orderBy(F.desc("c"), "nome").limit(n).collect()]


def flag_names(categories: list[str]) -> dict[str, str]:
    """A column name for each category; where letters and digits leave two alike, the later gets a number."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for category in dict.fromkeys(categories):
        plain = name = "cat_" + "".join(ch if ch.isalnum() else "_" for ch in category)
        n = 1
        while name.lower() in taken:  # column names differ by more than case
            n += 1
            name = f"{plain}_{n}"
        taken.add(name.lower())
        out[category] = name
    return out


def game_features(
    games: DataFrame, bridge: DataFrame, as_of: Column, categories: list[str] | None = None, fit_on: DataFrame | None = None
) -> DataFrame:
    """Age, developer reputation, category flags and the plain numbers of each game.

    ``fit_on`` are the games the reputation is learned from (default: all).
    """
    fit = games if fit_on is None else fit_on
    names = top_categories(bridge) if categories is None else categories
    dev = fit.where(F.col("desenvolvedor_id").isNotNull()).groupBy("desenvolvedor_id").agg(
        F.avg("avaliacao_media").alias("dev_reputacao")
    )
    overall = fit.agg(F.avg("avaliacao_media").alias("_mean"))
    age = F.coalesce(whole_days(F.col("data_lancamento"), as_of), F.lit(DEFAULT_AGE_DAYS))
    zero = F.lit(0.0)
    joined = (
        games.join(dev, "desenvolvedor_id", "left")
        .join(F.broadcast(overall))  # one row
        .join(categories_per_game(bridge), "id", "left")
    )
    return joined.select(
        "id",
        F.coalesce(F.col("preco_base").cast("double"), zero).alias("preco_base"),
        F.coalesce(F.col("metacritic_score").cast("double"), zero).alias("metacritic_score"),
        F.log1p(F.greatest(age, F.lit(0)).cast("double")).alias("idade_log"),
        F.coalesce("dev_reputacao", "_mean", zero).alias("dev_reputacao"),
        F.coalesce(F.col("total_avaliacoes").cast("double"), zero).alias("total_avaliacoes"),
        *[has_item(F.col("categorias"), c).alias(n) for c, n in flag_names(names).items()],
    )


def primary_genre(bridge: DataFrame) -> DataFrame:
    """First category name of each game."""
    return bridge.groupBy(F.col("jogo_id")).agg(F.min("nome").alias("genero"))


def genre_names(bridge: DataFrame) -> list[str]:
    """All primary genres and Unknown, for a pivot; `genre_share_rows` needs no such list."""
    rows = primary_genre(bridge).select("genero").distinct().orderBy("genero").collect()
    return [r["genero"] for r in rows if r["genero"] != "Unknown"] + ["Unknown"]


def genre_hours_rows(sessions: DataFrame, games: DataFrame, bridge: DataFrame) -> DataFrame:
    """Hours (h) by user and primary genre as rows, for any number of genres."""
    # folded per user and game first, so the genre join sees one row per pair
    hours = sessions.groupBy("usuario_id", "jogo_id").agg(F.sum("horas_jogadas").alias("h"))
    label = games.select(F.col("id").alias("jogo_id")).join(primary_genre(bridge), "jogo_id", "left")
    named = hours.join(label, "jogo_id").withColumn("genero", F.coalesce("genero", F.lit("Unknown")))
    # dealt by user once: sums, totals and a pivot by user need no further shuffle, a pivot's wide rows least of all
    return named.select("usuario_id", "genero", "h").repartition("usuario_id").groupBy("usuario_id", "genero").agg(F.sum("h").alias("h"))


def genre_share_rows(sessions: DataFrame, games: DataFrame, bridge: DataFrame) -> DataFrame:
    """(usuario_id, genero, share): the genre's part of the user's hours; users without hours have no rows."""
    rows = genre_hours_rows(sessions, games, bridge).where("h > 0")
    total = rows.groupBy("usuario_id").agg(F.sum("h").alias("_t"))
    return rows.join(total, "usuario_id").select("usuario_id", "genero", (F.col("h") / F.col("_t")).alias("share"))


def genre_hours(sessions: DataFrame, games: DataFrame, bridge: DataFrame, genres: list[str] | None = None) -> DataFrame:
    """Hours by user and primary genre as columns; absent is 0."""
    genres = genre_names(bridge) if genres is None else genres
    named = genre_hours_rows(sessions, games, bridge)
    return named.groupBy("usuario_id").pivot("genero", genres).agg(F.sum("h")).na.fill(0.0)


def user_genre_share(sessions: DataFrame, games: DataFrame, bridge: DataFrame, genres: list[str] | None = None) -> DataFrame:
    """Share of each primary genre in the user's hours; no hours gives zeros."""
    wide = genre_hours(sessions, games, bridge, genres)
    names = [c for c in wide.columns if c != "usuario_id"]
    total = sum((F.col(f"`{c}`") for c in names), F.lit(0.0))
    shares = [F.coalesce(F.try_divide(F.col(f"`{c}`"), F.col("_t")), F.lit(0.0)).alias(c) for c in names]
    return wide.withColumn("_t", total).select("usuario_id", *shares)


def user_engagement(sessions: DataFrame) -> DataFrame:
    """Distinct games, hours, mean hours, sessions with known hours, first session."""
    return sessions.groupBy("usuario_id").agg(
        F.count_distinct("jogo_id").alias("total_jogos_unicos"),
        F.coalesce(F.sum("horas_jogadas"), F.lit(0.0)).alias("total_horas"),
        F.avg("horas_jogadas").alias("media_horas_sessao"),
        F.count("horas_jogadas").alias("total_sessoes"),
        F.min("inicio").alias("primeira_sessao"),
    )


def session_frequency(engagement: DataFrame, as_of: Column) -> DataFrame:
    """Sessions per day since the first session (at least one day)."""
    days = F.greatest(F.lit(1), whole_days(F.col("primeira_sessao"), as_of))
    return engagement.withColumn("frequencia", F.col("total_sessoes") / days)


def minmax(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Scale to 0..1 over all rows; a constant column becomes 0."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(F.broadcast(bounds)).withColumn(alias or column, scaled.cast("double")).drop("_lo", "_hi")


def outlier_flag(df: DataFrame, column: str = "total_horas", q: float = 0.95) -> DataFrame:
    """1 where the value reaches the interpolated quantile."""
    limit = exact_quantiles(df, column, {"_limit": q})
    return df.join(F.broadcast(limit)).withColumn(
        "is_outlier", (F.col(column) >= F.col("_limit")).cast("int")
    ).drop("_limit")


def mean_hour(sessions: DataFrame) -> DataFrame:
    """Cosine and sine of the mean start hour of each user."""
    cos, sin = hour_cycle(F.col("_h"))
    return sessions.groupBy("usuario_id").agg(F.avg(F.hour("inicio")).alias("_h")).select(
        "usuario_id", cos.alias("hora_cos"), sin.alias("hora_sin")
    )


def user_condition(
    sessions: DataFrame,
    games: DataFrame,
    bridge: DataFrame,
    users: DataFrame,
    as_of: Column,
    clusters: DataFrame | None = None,
    n_clusters: int = 0,
) -> DataFrame:
    """Genre shares, cluster flags, frequency, play hour, variety and outlier flag per user."""
    stats = outlier_flag(session_frequency(user_engagement(sessions), as_of))
    stats = minmax(minmax(stats, "frequencia", "session_frequency"), "total_jogos_unicos", "unique_games_norm")
    out = (
        user_genre_share(sessions, games, bridge)
        .join(stats.select("usuario_id", "session_frequency", "unique_games_norm", "is_outlier"), "usuario_id")
        .join(mean_hour(sessions), "usuario_id")
    )
    if clusters is not None:
        flags = [(F.col("cluster") == i).cast("int").alias(f"cluster_{i}") for i in range(n_clusters)]
        out = out.join(clusters.select("usuario_id", *flags), "usuario_id", "left")
    return align_to(out, users.select(F.col("id").alias("usuario_id")), "usuario_id")


def interactions(sessions: DataFrame) -> DataFrame:
    """Weight of each (user, game): sum over sessions of ln(1 + hours) + 1."""
    weight = F.log1p(F.coalesce("horas_jogadas", F.lit(0.0))) + 1
    return sessions.groupBy("usuario_id", F.col("jogo_id").alias("item")).agg(F.sum(weight).alias("peso"))
