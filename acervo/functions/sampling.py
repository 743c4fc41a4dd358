"""Seeded draws that do not depend on partitioning or input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acervo.functions.prefix import running_totals

DRAWS = 1 << 60  # a draw is a whole number below
PAIR_DRAWS = (1 << 31) - 1  # a prime; the draw of a pair of keys is a whole number below


def draw(key: Column, seed: int) -> Column:
    """Pseudo-random number of a key: the first 60 bits of the MD5 of its text and the seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint")


def row_terms(key: Column, seed: int) -> tuple[Column, Column]:
    """Factor and offset of a row key: with the term x of another key, (factor * x + offset) % PAIR_DRAWS is the pair's draw.

    Each row key so has an order of its own over the other keys.
    """
    return 1 + draw(key, seed) % (PAIR_DRAWS - 1), draw(key, seed + 1) % PAIR_DRAWS


def column_term(key: Column, seed: int) -> Column:
    return draw(key, seed + 2) % PAIR_DRAWS


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows that come first in the seeded order of a unique key."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def split_frac(df: DataFrame, key: str, frac: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two parts that together hold every row once, ``frac`` of them in the first."""
    first = draw(F.col(key), seed) < int(frac * DRAWS)
    return df.where(first), df.where(~first)


def hash_place(df: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """Place of each row in the seeded order of its stratum: ``_c_before`` of ``_c_total``.

    ``key`` must be unique. The order is cut into buckets, so that a stratum
    holding most of the rows is still worked on by many tasks.
    """
    cells = df.withColumn("_h", draw(F.col(key), seed)).withColumn("_c", F.lit(1).cast("bigint"))
    return running_totals(cells, "_h", ["_c"], strata, [F.col("_h"), F.col(key)])


def split_stratified(
    df: DataFrame, key: str, strata: list[str], test: float = 0.2, validation: float = 0.0, seed: int = 42
) -> DataFrame:
    """Add ``split``: the same shares of every stratum go to test, validation and train.

    ``validation`` is a share of what the test part leaves over.
    """
    placed = hash_place(df, key, strata, seed)
    n_test = F.round(F.col("_c_total") * F.lit(test))
    n_val = F.round((F.col("_c_total") - n_test) * F.lit(validation))
    label = (
        F.when(F.col("_c_before") < n_test, "test")
        .when(F.col("_c_before") < n_test + n_val, "val")
        .otherwise("train")
    )
    return placed.withColumn("split", label).drop("_h", "_c", "_c_before", "_c_total")
