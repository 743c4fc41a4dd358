"""Conditional exploratory reports over the raw catalogue columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acervo.fixed_values import ACHIEVEMENT_BINS, ACHIEVEMENT_LABELS, PRICE_BINS, PRICE_LABELS
from acervo.functions.prefix import exact_quantiles
from acervo.functions.scalars import binned, items
from acervo.operators.profile import filter_range

PLAYTIME = "Average playtime forever"


def explode_multivalue(df: DataFrame, column: str) -> DataFrame:
    """One row per trimmed piece of a comma-separated column."""
    return df.withColumn(column, F.explode(items(F.col(column))))


def _grouped(df: DataFrame, group: str, value: str, min_count: int) -> DataFrame:
    """Count, mean, median and deviation per group, for groups above ``min_count``.

    The frequency filter works on the grouped rows; the detail rows are never
    shuffled by group.
    """
    base = (
        df.groupBy(group)
        .agg(
            F.count("*").alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
        )
        .where(F.col("count") > min_count)
    )
    return base.join(exact_quantiles(df, value, {"median": 0.5}, [group]), group)


def category_prices(df: DataFrame) -> DataFrame:
    return explode_multivalue(df.select("Categories", "Price").na.drop(), "Categories")


def genre_playtimes(df: DataFrame) -> DataFrame:
    rows = explode_multivalue(df.select("Genres", PLAYTIME).na.drop(), "Genres")
    return rows.where(F.col(PLAYTIME) > 0)


def eda_price_by_category(df: DataFrame, min_count: int = 500) -> DataFrame:
    out = _grouped(category_prices(df), "Categories", "Price", min_count)
    return out.orderBy(F.desc("mean"), "Categories")


def eda_playtime_by_genre(df: DataFrame, min_count: int = 500) -> DataFrame:
    out = _grouped(genre_playtimes(df), "Genres", PLAYTIME, min_count).drop("std")
    return out.orderBy(F.desc("median"), "Genres")


def developer_consistency(df: DataFrame, min_games: int = 5, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Best and worst developers by mean score, the steadier first."""
    stats = (
        df.where(F.col("Developers").isNotNull())
        .groupBy("Developers")
        .agg(
            F.avg("User score").alias("mean"),
            F.stddev_samp("User score").alias("std"),
            F.count("User score").alias("count"),
        )
        .where(F.col("std").isNotNull() & (F.col("count") >= min_games))
    )
    best = stats.orderBy(F.desc("mean"), F.asc("std"), "Developers").limit(top)
    worst = stats.orderBy(F.asc("mean"), F.asc("std"), "Developers").limit(top)
    return best, worst


def achievers(df: DataFrame) -> DataFrame:
    rows = df.select("Achievements", PLAYTIME).na.drop()
    return filter_range(rows, "Achievements", 0, 500, PLAYTIME)


def playtime_by_tier(df: DataFrame) -> DataFrame:
    """Median and mean play time per achievement tier."""
    rows = achievers(df).withColumn(
        "tier", binned(F.col("Achievements"), ACHIEVEMENT_BINS, ACHIEVEMENT_LABELS)
    )
    mean = rows.groupBy("tier").agg(F.avg(PLAYTIME).alias("mean"))
    return mean.join(exact_quantiles(rows, PLAYTIME, {"median": 0.5}, ["tier"]), "tier")


def price_scores(df: DataFrame) -> DataFrame:
    """Positive share and price tier of each game."""
    rows = df.select("Price", "Positive", "Negative", "User score").na.drop()
    total = F.col("Positive") + F.col("Negative")
    score = F.col("Positive") / F.when(total == 0, F.lit(1)).otherwise(total)
    return rows.select(
        score.alias("score"), binned(F.col("Price"), PRICE_BINS, PRICE_LABELS).alias("tier")
    ).where("tier IS NOT NULL")


def score_by_price_tier(df: DataFrame) -> DataFrame:
    return _grouped(price_scores(df), "tier", "score", 0)
