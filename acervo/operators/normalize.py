"""From one wide raw catalogue to games, developers, categories and their bridge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from acervo.functions.scalars import capitalized, id_from_url, number_or_zero, rating_of_five, title_case, uuid5

MULTI = ("Categories", "Genres", "Tags")
NUMBERS = ("Achievements", "Price", "Positive", "Negative", "Average playtime forever", "Required age")


def realign(raw: DataFrame) -> DataFrame:
    """Recover the id from the image links and undo the column shift.

    The raw rows hold the name in ``AppID`` and the date in ``Name``.
    """
    dev = F.coalesce("Developers", "Publishers", F.lit("Unknown Developer"))
    new = {
        "AppID": F.coalesce(id_from_url(F.col("Header image"), F.col("Screenshots")), F.lit(0).cast("bigint")),
        "Name": F.coalesce(F.col("AppID").cast("string"), F.lit("Unknown Game")),
        "Release date": F.col("Name"),
        "Developers": title_case(F.trim(dev)),
    }
    new |= {c: number_or_zero(F.col(f"`{c}`")) for c in NUMBERS if c in raw.columns}
    return raw.withColumns(new)


def valid_games(df: DataFrame) -> DataFrame:
    return df.where(F.col("AppID") > 0)


def _names(columns: Sequence[str]) -> Column:
    """Distinct, non-blank, capitalized pieces of the multi-value columns."""
    pieces = F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), ",") for c in columns]))
    return F.filter(F.array_distinct(F.transform(pieces, lambda x: capitalized(x))), lambda x: x != "")


def category_dim(df: DataFrame, columns: Sequence[str] = MULTI) -> DataFrame:
    names = df.select(F.explode(_names(columns)).alias("nome")).distinct()
    return names.select(uuid5(F.col("nome")).alias("id"), "nome")


def developer_dim(df: DataFrame) -> DataFrame:
    return df.select(F.col("Developers").alias("nome")).distinct().select(
        uuid5(F.col("nome")).alias("id"), "nome", F.lit("Unknown").alias("pais")
    )


def game_id() -> Column:
    return uuid5(F.col("AppID").cast("string"))


def category_bridge(df: DataFrame, columns: Sequence[str] = MULTI) -> DataFrame:
    """Game and category ids, each pair once."""
    pairs = df.select(game_id().alias("jogo_id"), F.explode(_names(columns)).alias("nome")).distinct()
    return pairs.select("jogo_id", uuid5(F.col("nome")).alias("categoria_id"))


def game_rows(df: DataFrame, order_by: Column | None = None) -> DataFrame:
    """One row per game. Of repeated ids the later row (by ``order_by``) gives
    title, price and rating, the earlier one everything else."""
    pos, neg = F.col("Positive"), F.col("Negative")
    rows = df.select(
        "AppID",
        (order_by if order_by is not None else F.struct("Name", "Price", "Positive", "Negative")).alias("_o"),
        F.struct(
            F.col("Name").alias("titulo"),
            F.col("Price").alias("preco_base"),
            rating_of_five(pos, neg).alias("avaliacao_media"),
        ).alias("new"),
        F.struct(
            (pos + neg).cast("bigint").alias("total_avaliacoes"),
            F.col("Required age").cast("int").alias("idade_requerida"),
            uuid5(F.col("Developers")).alias("desenvolvedor_id"),
        ).alias("old"),
    )
    one = rows.groupBy("AppID").agg(F.max_by("new", "_o").alias("new"), F.min_by("old", "_o").alias("old"))
    return one.select(game_id().alias("id"), "new.*", "old.*")


def normalize_catalog(raw: DataFrame, order_by: Column | None = None) -> dict[str, DataFrame]:
    df = valid_games(realign(raw))
    return {
        "jogos": game_rows(df, order_by),
        "desenvolvedores": developer_dim(df),
        "categorias": category_dim(df),
        "jogos_categorias": category_bridge(df),
    }
