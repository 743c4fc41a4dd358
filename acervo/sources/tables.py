"""Reading and writing catalogue files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from acervo.operators.market import categories_per_game
from acervo.operators.profile import top_values
from acervo.sources.csv_rows import read_quoted_csv
from acervo.sources.versions import next_version, write_version  # noqa: F401


def read_catalog_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; the schema is given, never inferred. One large file is read by many tasks."""
    return read_quoted_csv(spark, path, schema)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """A database table in parallel ranges of ``column``."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column,
        lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts),
    )
    return reader.options(**options).load()


def extract_ml_tables(
    games: DataFrame, devs: DataFrame, bridge: DataFrame, users: DataFrame, sessions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Game features with developer and category list, user features, interactions."""
    dev = devs.select(F.col("id").alias("dev_id"), F.col("nome").alias("dev_nome"))
    facts = games.select(
        "id", "titulo", "preco_base", "avaliacao_media", "total_avaliacoes", "metacritic_score",
        "idade_requerida", "data_lancamento", "desenvolvedor_id",
    )
    wide = (
        facts.join(dev, F.col("desenvolvedor_id") == F.col("dev_id"), "left")
        .drop("desenvolvedor_id")
        .join(categories_per_game(bridge), "id", "left")
    )
    return (
        wide,
        users.select("id", "pais", "tipo_assinatura"),
        sessions.select("usuario_id", "jogo_id", "horas_jogadas", "inicio"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks at the ends of a text are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_splits(df: DataFrame, path: str) -> None:
    """One parquet folder per value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def catalog_profile(df: DataFrame, split_counts: DataFrame, prices: DataFrame) -> DataFrame:
    """Split sizes, price figures and the 20 top genres as one JSON text row."""
    top = top_values(df, "Genres", 20, split=True).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "valor", "n"))).alias("g")
    )
    genres = F.transform("g", lambda x: F.struct(x["valor"].alias("genero"), x["n"].alias("n")))
    one = split_counts.select(F.struct("*").alias("temporal_split_sizes")).join(
        F.broadcast(prices.select(F.struct("*").alias("price_stats")))
    )
    one = one.join(F.broadcast(top)).select("temporal_split_sizes", "price_stats", genres.alias("top_genres"))
    return one.select(F.to_json(F.struct("*")).alias("value"))


def write_profile_json(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").text(path)


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target``; of repeated keys the first."""
    keys = list(keys)
    order = F.struct(*[F.col(c) for c in (order_by or new.columns)])
    first = new.groupBy(*keys).agg(F.min_by(F.struct("*"), order).alias("r")).select("r.*")
    return first.join(target.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], update_cols: Sequence[str]) -> DataFrame:
    """Target after the merge: known keys change only ``update_cols``, new keys come whole.

    ``new`` must hold each key once. Write the result to a new version folder.
    """
    keys = list(keys)
    fresh = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in target.columns if c not in keys], F.lit(True).alias("_in"))
    old = target.withColumn("_known", F.lit(True))
    both = old.join(fresh, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return both.select(*out)


def reload(df: DataFrame, path: str) -> None:
    """Truncate and load."""
    df.write.mode("overwrite").parquet(path)


def finished_sessions(df: DataFrame) -> DataFrame:
    """Validated session rows with start time and platform.

    Kept are rows with positive minutes and a platform of at most 50 letters;
    the platform defaults to PC.
    """
    from acervo.functions.scalars import minutes_before

    name = F.coalesce("plataforma", F.lit("PC")) if "plataforma" in df.columns else F.lit("PC")
    return (
        df.withColumn("plataforma", name)
        .where((F.col("minutos") > 0) & (F.length("plataforma") <= 50))
        .withColumn("inicio", minutes_before(F.col("fim"), F.col("minutos")))
        .select("usuario_id", "jogo_id", "inicio", "fim", "plataforma")
    )


def append_sessions(df: DataFrame, path: str) -> None:
    finished_sessions(df).write.mode("append").parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a summary once and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
