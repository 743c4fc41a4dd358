"""Hypothesis tests and correlations from distributed aggregates.

Every test folds the data to group or value counts; only one row (or one row
per group) reaches the closed form and its tail probability.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from acervo.functions.prefix import running_totals, value_counts
from acervo.functions.tails import chi2_p, f_p, ks_p, r_p
from acervo.fixed_values import NUMERIC_COLUMNS, TEXT_COLUMNS
from acervo.session import cut_lineage


def anova(df: DataFrame, group: str, value: str, min_count: int = 0) -> DataFrame:
    """One-way analysis of variance: F, p, k, n over groups larger than ``min_count``."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    per = rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("m"),
        (F.var_pop(value) * F.count("*")).alias("m2"),
    )
    per = per.where(F.col("n") > min_count)
    total = _between(per)
    f = F.try_divide(
        F.col("between") / (F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))
    )
    out = total.where("k > 1").withColumn("f", f)
    return out.select("f", f_p(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")).alias("p"), "k", "n")


def _between(per: DataFrame) -> DataFrame:
    grand = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    # one row: the grand mean
    return (
        per.join(F.broadcast(grand))
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum("m2").alias("within"),
            F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("between"),
        )
    )


def kruskal(df: DataFrame, group: str, value: str, min_count: int = 0) -> DataFrame:
    """Kruskal-Wallis H with tie correction, p, k, n."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    cells = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    if min_count:
        big = cells.groupBy(group).agg(F.sum("c").alias("gn")).where(F.col("gn") > min_count)
        cells = cells.join(big.select(group), group, "left_semi")
    cells = cut_lineage(cells)  # ranked by value, then summed by group
    per_value = cells.groupBy(value).agg(F.sum("c").alias("n"))
    ranks = running_totals(per_value, value, ["n"]).select(
        F.col(value).alias("_v"),
        (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"),
        "n",
        F.col("n_total").alias("nn"),
    )
    sums = (
        cells.join(ranks, F.col(value) == F.col("_v"))
        .groupBy(group)
        .agg(
            F.sum("c").alias("ng"),
            F.sum(F.col("c") * (F.col("rank") - (F.col("nn") + 1) / F.lit(2.0))).alias("dev"),
            F.max("nn").alias("nn"),
        )
        .agg(
            F.count("*").alias("k"),
            F.coalesce(F.max("nn"), F.lit(0)).alias("n"),
            F.sum(F.col("dev") * F.col("dev") / F.col("ng")).alias("spread"),
        )
    )
    n3 = F.col("n").cast("double")
    ties = ranks.agg(F.sum(F.pow(n3, 3) - n3).alias("ties"))
    nn = F.col("n").cast("double")
    h = 12.0 / (nn * (nn + 1)) * F.col("spread")
    fix = 1.0 - F.col("ties") / (F.pow(nn, 3) - nn)
    out = sums.join(F.broadcast(ties)).withColumn("h", F.try_divide(h, fix))
    return out.select("h", chi2_p(F.col("h"), F.col("k") - 1).alias("p"), "k", "n")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.agg(safe_corr(F.col(x), F.col(y)).alias("r"), F.count("*").alias("n"))
    return out.select("r", r_p(F.col("r"), F.col("n") - 2).alias("p"), "n")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties."""
    pairs = cut_lineage(  # read for both rankings and for the sums
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count("*").alias("w"))
    )

    def centred(side: str) -> DataFrame:
        run = running_totals(pairs.groupBy(side).agg(F.sum("w").alias("n")), side, ["n"])
        mid = F.col("n_before") + (F.col("n") - F.col("n_total")) / F.lit(2.0)
        return run.select(side, mid.alias(f"r{side}"))

    w, rx, ry = F.col("w"), F.col("r_x"), F.col("r_y")
    out = (
        pairs.join(centred("_x"), "_x")
        .join(centred("_y"), "_y")
        .agg(
            F.try_divide(F.sum(w * rx * ry), F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))).alias("rho"),
            F.sum("w").alias("n"),
        )
    )
    return out.select("rho", r_p(F.col("rho"), F.col("n") - 2).alias("p"), "n")


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y with z held fixed: n, r, 95 % interval, p."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    three = rows.agg(
        F.count("*").alias("n"),
        safe_corr(F.col(x), F.col(y)).alias("xy"),
        safe_corr(F.col(x), F.col(z)).alias("xz"),
        safe_corr(F.col(y), F.col(z)).alias("yz"),
    )
    rest = F.sqrt((1 - F.pow("xz", 2)) * (1 - F.pow("yz", 2)))
    r = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), rest)
    out = three.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))  # rounding may lead past the ends
    out = out.withColumn("r", F.when(r.isNotNull(), F.col("r")))
    width = F.lit(1.959963984540054) / F.sqrt(F.greatest(F.col("n") - 4, F.lit(1)))
    z_of = F.atanh(F.col("r"))
    return out.select(
        "n",
        "r",
        F.tanh(z_of - width).alias("ci_low"),
        F.tanh(z_of + width).alias("ci_high"),
        r_p(F.col("r"), F.col("n") - 3).alias("p"),
    )


def loglog_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line through (log10 x, log10 y) over the positive pairs."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(
        F.log10(F.col(x).cast("double")).alias("lx"), F.log10(F.col(y).cast("double")).alias("ly")
    )
    out = rows.agg(
        F.count("*").alias("n"),
        F.regr_slope("ly", "lx").alias("slope"),
        F.regr_intercept("ly", "lx").alias("intercept"),
        safe_corr(F.col("lx"), F.col("ly")).alias("r"),
        F.regr_r2("ly", "lx").alias("r2"),
        F.regr_syy("ly", "lx").alias("syy"),
        F.regr_sxx("ly", "lx").alias("sxx"),
    )
    se = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("syy"), F.col("sxx") * (F.col("n") - 2)))
    return out.select(
        "n", "slope", "intercept", "r", "r2", se.alias("stderr"), r_p(F.col("r"), F.col("n") - 2).alias("p")
    )


def _ks_one(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    left = value_counts(a, column).select(F.col(column).cast("double").alias("v"), F.col("n").alias("n1"), F.lit(0).cast("bigint").alias("n2"))
    right = value_counts(b, column).select(F.col(column).cast("double").alias("v"), F.lit(0).cast("bigint").alias("n1"), F.col("n").alias("n2"))
    cells = left.unionByName(right).groupBy("v").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    run = running_totals(cells, "v", ["n1", "n2"])
    f1 = F.try_divide(F.col("n1_before") + F.col("n1"), F.col("n1_total"))
    f2 = F.try_divide(F.col("n2_before") + F.col("n2"), F.col("n2_total"))
    return run.agg(
        F.max(F.abs(f1 - f2)).alias("d"), F.max("n1_total").alias("n1"), F.max("n2_total").alias("n2")
    ).select(F.lit(column).alias("coluna"), "d", "n1", "n2")


KS_EXACT = 10_000


def ks_2samp(a: DataFrame, b: DataFrame, columns: Sequence[str], exact_up_to: int = KS_EXACT) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per column; ``passou`` means p > 0.05.

    ``p`` is exact while the larger sample has at most ``exact_up_to`` values
    (n1 * n2 cells of work on the one result row) and that of the limit law beyond.
    """
    parts = [_ks_one(a, b, c) for c in columns]
    out = reduce(DataFrame.unionByName, parts).where("n1 > 0 AND n2 > 0")
    out = out.withColumn("p", ks_p(F.col("d"), F.col("n1"), F.col("n2"), exact_up_to))
    return out.withColumn("passou", F.col("p") > 0.05)


def enforce_types(
    df: DataFrame, numeric: Sequence[str] = tuple(NUMERIC_COLUMNS), text: Sequence[str] = tuple(TEXT_COLUMNS)
) -> DataFrame:
    """Numbers as DOUBLE (null when not a number), texts as STRING, others unchanged."""
    changes = {c: F.col(f"`{c}`").try_cast("double") for c in numeric if c in df.columns}
    changes |= {c: F.col(f"`{c}`").cast("string") for c in text if c in df.columns}
    out = df.withColumns(changes)
    kinds = dict(out.dtypes)
    wrong = [c for c in numeric if kinds.get(c, "double") != "double"]
    wrong += [c for c in text if kinds.get(c, "string") != "string"]
    if wrong:
        raise TypeError(f"columns with a wrong type: {wrong}")
    return out
