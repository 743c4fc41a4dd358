"""Ranks, running totals and exact quantiles without one-task groups.

A window over a whole group (or the whole table) puts that group into one
task. Here the rows are first folded to distinct values, the values are cut
into ordered buckets by approximate quantiles, each (group, bucket) piece is
scanned on its own, and the totals of the earlier buckets are added. The
quantiles only decide how even the pieces are; the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from acervo.session import shuffle_width, written

_BUCKET = "_bucket"


def with_bucket(cells: DataFrame, by: str, pieces: int | None = None) -> DataFrame:
    """Add an order-preserving bucket number of the numeric column ``by``.

    The bounds become literals of the plan, so every reading of the result
    agrees on them, also after a lost executor.
    """
    n = pieces or shuffle_width(cells.sparkSession)
    probs = [i / n for i in range(1, n)]
    keyed = cells.withColumn("_by", F.col(by).cast("double"))
    found = keyed.approxQuantile("_by", probs, min(0.01, 0.5 / n))
    bounds = sorted({b for b in found if math.isfinite(b)})  # the outer pieces hold the infinities
    if not bounds:
        return keyed.drop("_by").withColumn(_BUCKET, F.lit(0.0))
    cut = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")],
        inputCol="_by",
        outputCol=_BUCKET,
        handleInvalid="keep",
    )
    return cut.transform(keyed).drop("_by")


def running_totals(
    cells: DataFrame,
    by: str,
    measures: Sequence[str],
    group: Sequence[str] = (),
    order: Sequence[Column] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """For each measure add ``<m>_before`` (sum over earlier rows) and ``<m>_total``.

    ``cells`` holds one row per group and order key. ``by`` is the numeric
    column that leads the ascending ``order``. The folded cells are written
    once to the shared folder: the bounds, the scan of the pieces and their
    totals all read them, and what lies before them runs a single time.
    """
    group = list(group)
    order = list(order) if order else [F.col(by)]
    keyed = with_bucket(written(cells), by, pieces)
    piece = W.partitionBy(*group, _BUCKET)
    upto = piece.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)

    sums = keyed.groupBy(*group, _BUCKET).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    whole = W.partitionBy(*(group or [F.lit(0)]))
    earlier = whole.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col(_BUCKET).alias("_b"),
        *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    local = keyed.select(
        "*", *[(F.sum(m).over(upto) - F.col(m)).alias(f"_l_{m}") for m in measures]
    )
    match = F.col(_BUCKET) == F.col("_b")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(offsets, match)
    for m in measures:
        joined = joined.withColumn(f"{m}_before", F.col(f"_l_{m}") + F.col(f"_o_{m}"))
    return joined.drop(
        _BUCKET, "_b", *[f"_g_{g}" for g in group],
        *[f"_l_{m}" for m in measures], *[f"_o_{m}" for m in measures],
    )


def value_counts(
    df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Distinct non-null values with their counts ``n`` (combined before the shuffle).

    ``weight`` names a count column of rows that were folded before.
    """
    n = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(n.alias("n"))


def average_ranks(
    df: DataFrame, value: str, group: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Per distinct value: ``n`` and ``avg_rank`` (ties share the mean rank)."""
    run = running_totals(value_counts(df, value, group, weight), value, ["n"], group)
    return run.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def _pick(position: Column, value: str) -> Column:
    inside = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    return F.max(F.when(inside, F.col(value).cast("double")))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    group: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``."""
    run = running_totals(value_counts(df, value, group, weight), value, ["n"], group)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n_total") - 1)
        picks += [
            _pick(F.floor(at), value).alias(f"_lo_{name}"),
            _pick(F.ceil(at), value).alias(f"_hi_{name}"),
        ]
    found = run.groupBy(*group).agg(F.max("n_total").alias("_n"), *picks)
    out = [F.col(g) for g in group]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*out)


def upper_median(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """The element at position n // 2 of the sorted values, as ``mediana``."""
    run = running_totals(value_counts(df, value, group), value, ["n"], group)
    middle = F.floor(F.col("n_total") / 2)
    return run.groupBy(*group).agg(_pick(middle, value).alias("mediana"))
