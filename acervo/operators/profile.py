"""Missing-value reports, column profiles, frequency tables and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from acervo.functions.prefix import exact_quantiles, upper_median
from acervo.functions.scalars import items


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def dropna(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def keep_frequent(df: DataFrame, column: str, min_count: int = 500) -> DataFrame:
    """Rows whose value of ``column`` occurs more than ``min_count`` times."""
    often = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > min_count)
    return df.join(often.select(column), column, "left_semi")


def cap_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows up to the interpolated quantile; the bound is a literal the scan can use."""
    row = exact_quantiles(df, column, {"cap": q}).first()
    if row is None or row["cap"] is None:
        return df.where(F.lit(False))
    return df.where(F.col(column) <= F.lit(row["cap"]))


def filter_range(df: DataFrame, column: str, low: float, high: float, positive: str) -> DataFrame:
    """low < column <= high and positive > 0."""
    return df.where((F.col(column) > low) & (F.col(column) <= high) & (F.col(positive) > 0))


def percentile_linear(df: DataFrame, column: str, p: float) -> DataFrame:
    """Interpolated percentile, 0 for an empty column."""
    return exact_quantiles(df, column, {"percentil": p}).select(
        F.coalesce("percentil", F.lit(0.0)).alias("percentil")
    ) if df.limit(1).count() else df.sparkSession.range(1).select(F.lit(0.0).alias("percentil"))


def summary_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, upper median and population deviation; zeros for an empty column."""
    base = df.agg(
        F.coalesce(F.avg(column), F.lit(0.0)).alias("media"),
        F.coalesce(F.stddev_pop(column), F.lit(0.0)).alias("desvio"),
    )
    middle = upper_median(df, column).agg(F.coalesce(F.max("mediana"), F.lit(0.0)).alias("mediana"))
    return base.join(F.broadcast(middle)).select("media", "mediana", "desvio")


def group_mode(df: DataFrame, key: str, column: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the first value in order."""
    counts = df.where(F.col(column).isNotNull() & F.col(key).isNotNull()).groupBy(key, column).agg(
        F.count("*").alias("n")
    )
    return counts.groupBy(key).agg(
        F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("moda")
    )


def value_table(df: DataFrame, column: str, split: bool = False) -> DataFrame:
    """Counts per value, or per comma-separated piece of it."""
    value = F.explode(items(F.col(column))) if split else F.col(column)
    return df.select(value.alias("valor")).where("valor IS NOT NULL").groupBy("valor").agg(
        F.count("*").alias("n")
    )


def top_values(df: DataFrame, column: str, n: int = 10, split: bool = False) -> DataFrame:
    return value_table(df, column, split).orderBy(F.desc("n"), "valor").limit(n)


def _missing(df: DataFrame, column: str) -> Column:
    gone = F.col(f"`{column}`").isNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        gone = gone | F.isnan(F.col(f"`{column}`"))
    return gone


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percent missing per column, only where above zero; one pass over the data."""
    columns = list(columns or df.columns)
    shares = df.agg(*[F.avg(_missing(df, c).cast("int") * F.lit(100.0)).alias(c) for c in columns])
    long = shares.unpivot([], columns, "coluna", "pct_missing")
    return long.where("pct_missing > 0").orderBy(F.desc("pct_missing"), "coluna")


def column_diagnostics(df: DataFrame, order_by: str) -> DataFrame:
    """Type, null count and first value (by ``order_by``) of every column."""
    kinds = dict(df.dtypes)
    names = df.columns
    key = F.col(f"`{order_by}`")
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.count_if(_missing(df, c)).alias(f"n{i}"),
            F.min_by(F.struct(F.col(f"`{c}`").cast("string").alias("v")), key).alias(f"f{i}"),
        ]
    row = df.agg(*aggs)
    entries = [
        F.struct(
            F.lit(c).alias("coluna"),
            F.lit(kinds[c]).alias("tipo"),
            F.col(f"n{i}").alias("nulos"),
            F.col(f"f{i}")["v"].alias("primeiro"),
        )
        for i, c in enumerate(names)
    ]
    return row.select(F.inline(F.array(*entries)))


def temporal_split_counts(df: DataFrame, when: str, cuts: tuple[int, int] = (2018, 2020)) -> DataFrame:
    """Rows up to the first cut year, between the cuts, and after."""
    y = F.year(when)
    return df.agg(
        F.count_if(y <= cuts[0]).alias("treino"),
        F.count_if((y > cuts[0]) & (y <= cuts[1])).alias("validacao"),
        F.count_if(y > cuts[1]).alias("teste"),
    )


def price_profile(df: DataFrame, column: str = "Price") -> DataFrame:
    """Mean, sample deviation and median of a column."""
    base = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    middle = exact_quantiles(df, column, {"median": 0.5})
    return base.join(F.broadcast(middle))
