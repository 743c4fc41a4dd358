"""A summary per key that follows new rows without reading the old ones again.

A state holds count, sum, sum of squares about the mean, least and largest value of a
key. Two states of the same key merge into that of all their rows, so a refresh
summarises the new rows alone and merges them with the newest version.
Versions are whole or absent (see ``versions``); each names the batches it holds, so
that a batch is counted once also when its refresh runs again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acervo.sources.versions import finished_versions, read_version, version_notes, write_version

PARTS = ("n", "soma", "quadrados", "menor", "maior")


def value_states(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The state of every key: keys, n, soma, quadrados, menor, maior. Null values count for nothing."""
    v = F.col(value).cast("double")
    n = F.count(v)
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("soma"),
        F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("quadrados"),
        F.min(v).alias("menor"),
        F.max(v).alias("maior"),
    )


def merge_states(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of the rows of both sides. Squares are taken about the common mean, so nothing cancels out."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(p).alias(f"_{p}") for p in PARTS])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    # a null key is a group of its own; a mark tells whether a side has it
    both = left.withColumn("_left", F.lit(True)).join(other.withColumn("_right", F.lit(True)), same, "full_outer")

    def either(name: str) -> Column:
        return F.when(F.col("_left").isNotNull(), F.col(name)).otherwise(F.col(f"_k_{name}")).alias(name)

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a, b = zero("n"), zero("_n")
    apart = F.try_divide(F.col("soma"), a) - F.try_divide(F.col("_soma"), b)
    between = F.coalesce(apart * apart * a * b / (a + b), F.lit(0.0))
    return both.select(
        *[either(k) for k in keys],
        (a + b).alias("n"),
        (zero("soma") + zero("_soma")).alias("soma"),
        (zero("quadrados") + zero("_quadrados") + between).alias("quadrados"),
        F.least("menor", "_menor").alias("menor"),
        F.greatest("maior", "_maior").alias("maior"),
    )


def summary_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, total, media, desvio (sample), menor, maior."""
    return states.select(
        *keys,
        F.col("n").alias("total"),
        F.try_divide(F.col("soma"), F.col("n")).alias("media"),
        F.sqrt(F.try_divide(F.col("quadrados"), F.col("n") - 1)).alias("desvio"),
        "menor",
        "maior",
    )


def batches_in(spark: SparkSession, path: str) -> list[str]:
    """The batches that the newest version holds, in the order they came."""
    have = finished_versions(spark, path)
    return json.loads(version_notes(spark, path, have[-1]) or "[]") if have else []


def refresh_summary(rows: DataFrame, path: str, keys: Sequence[str], value: str, batch: str) -> int:
    """Merge the states of a batch of new rows into the newest version; gives the number of the version that holds it.

    A batch that the newest version names already changes nothing. Refreshes of one path run
    one after another; a batch has a name of its own.
    """
    spark = rows.sparkSession
    have, known = finished_versions(spark, path), batches_in(spark, path)
    if batch in known:
        return have[-1]
    new = value_states(rows, keys, value)
    states = merge_states(read_version(spark, path), new, keys) if have else new
    return write_version(states, path, json.dumps([*known, batch]))


def read_summary(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The summary by the newest version."""
    return summary_of(read_version(spark, path), keys)
