"""Quality measures of recommendation lists.

``recs`` holds (usuario_id, rank, item[, score]), one row per list position;
``truth`` holds distinct (usuario_id, item).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from acervo.fixed_values import (
    CLICK_HIGH,
    CLICK_LOW,
    CLICK_MID,
    DEFAULT_SESSION_TIME,
    GENRE_BASE_SESSION_TIME,
)
from acervo.functions.prefix import running_totals
from acervo.functions.sampling import draw
from acervo.operators.stats import safe_corr
from acervo.session import cut_lineage


def hit_table(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """List positions with ``hit`` (0/1), hits so far and the user's truth size."""
    sizes = truth.groupBy("usuario_id").agg(F.count("*").alias("n_truth"))
    marked = recs.join(truth.withColumn("_t", F.lit(1)), ["usuario_id", "item"], "left").withColumn(
        "hit", F.coalesce("_t", F.lit(0))
    )
    sofar = W.partitionBy("usuario_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        marked.drop("_t")
        .withColumn("hits_so_far", F.sum("hit").over(sofar))
        .join(sizes, "usuario_id", "left")
        .withColumn("n_truth", F.coalesce("n_truth", F.lit(0)))
    )


def _ideal(n: Column, k: int) -> Column:
    """Best possible gain with min(n, k) relevant items; the table of sums is fixed by k."""
    sums, total = [0.0], 0.0
    for i in range(k):
        total += 1.0 / math.log2(i + 2)
        sums.append(total)
    table = F.array(*[F.lit(v) for v in sums])
    return F.element_at(table, F.least(n, F.lit(k)).cast("int") + 1)


def _at(k: int) -> Column:
    return F.col("rank") <= k


def _user_measures(ks: Sequence[int]) -> list[Column]:
    size = F.max("n_truth")
    out = []
    for k in ks:
        hits = F.sum(F.when(_at(k), F.col("hit")).otherwise(0))
        gain = F.sum(F.when(_at(k), F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
        out += [
            (hits / F.lit(float(k))).alias(f"precision_{k}"),
            F.coalesce(F.try_divide(hits, size), F.lit(0.0)).alias(f"recall_{k}"),
            F.coalesce(F.try_divide(gain, _ideal(size, k)), F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    top = max(ks)
    ap = F.sum(F.when(_at(top), F.col("hit") * F.col("hits_so_far") / F.col("rank")).otherwise(0.0))
    out.append(F.coalesce(F.try_divide(ap, F.least(size, F.lit(top))), F.lit(0.0)).alias("ap"))
    out.append(F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return out


def user_measures(recs: DataFrame, truth: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """All measures of every user with a list, for all cut-offs in one pass."""
    return hit_table(recs, truth).groupBy("usuario_id").agg(*_user_measures(ks))


def _mean(recs: DataFrame, truth: DataFrame, k: int, pick: str, name: str) -> DataFrame:
    return user_measures(recs, truth, [k]).agg(F.coalesce(F.avg(pick), F.lit(0.0)).alias(name))


def precision_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(recs, truth, k, f"precision_{k}", "precision")


def recall_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(recs, truth, k, f"recall_{k}", "recall")


def map_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(recs, truth, k, "ap", "map")


def ndcg_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return _mean(recs, truth, k, f"ndcg_{k}", "ndcg")


def mrr(recs: DataFrame, truth: DataFrame) -> DataFrame:
    return _mean(recs, truth, 1, "rr", "mrr")


def coverage(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of the catalogue that is recommended at least once."""
    size = catalog.agg(F.count_distinct("item").alias("n"))
    seen = recs.agg(F.count_distinct("item").alias("itens"))
    share = F.coalesce(F.try_divide("itens", "n"), F.lit(0.0))
    return seen.join(F.broadcast(size)).select("itens", share.alias("cobertura"))


def offline_report(
    recs: DataFrame, truth: DataFrame, catalog: DataFrame, ks: Sequence[int] = (5, 10, 20)
) -> DataFrame:
    """Long table (metrica, valor) of all measures; MAP at the largest cut-off."""
    recs = cut_lineage(recs)  # the measures and the coverage read the lists
    per_user = user_measures(recs, truth, ks)
    names = [c for c in per_user.columns if c != "usuario_id"]
    wide = per_user.agg(*[F.avg(c).alias(c) for c in names]).join(
        F.broadcast(coverage(recs, catalog).select(F.col("cobertura").alias("coverage")))
    )
    wide = wide.withColumnsRenamed({"ap": "map", "rr": "mrr"})
    return wide.unpivot([], wide.columns, "metrica", "valor")


def mode_report(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct items, catalogue share and mean score per mode."""
    size = catalog.agg(F.count_distinct("item").alias("n"))
    return (
        recs.groupBy("modo")
        .agg(F.count_distinct("item").alias("unicos"), F.avg("score").alias("score_medio"))
        .join(F.broadcast(size))
        .select("modo", "unicos", (F.try_divide("unicos", "n") * 100).alias("pct"), "score_medio")
    )


def mode_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items two lists of a user have in common."""
    both = a.select("usuario_id", "item").intersect(b.select("usuario_id", "item"))
    n = both.groupBy("usuario_id").agg(F.count("*").alias("n"))
    return a.select("usuario_id").distinct().join(n, "usuario_id", "left").select(
        "usuario_id", F.coalesce("n", F.lit(0)).alias("em_comum")
    )


def item_frequency(recs: DataFrame) -> DataFrame:
    return recs.groupBy("item").agg(F.count("*").alias("freq"))


def popularity_bias(recs: DataFrame, popularity: DataFrame) -> DataFrame:
    """Correlation of list frequency and popularity; 0 without items, null if constant."""
    pairs = item_frequency(recs).join(popularity, "item")
    r = safe_corr(F.col("freq"), F.col("popularidade"))
    return pairs.agg(F.when(F.count("*") == 0, F.lit(0.0)).otherwise(r).alias("vies"))


def gini(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inequality of list frequency over the catalogue, items never listed included."""
    freq = F.coalesce("freq", F.lit(0))
    levels = (
        catalog.select("item").distinct().join(item_frequency(recs), "item", "left")
        .groupBy(freq.alias("freq"))
        .agg(F.count("*").alias("n"))
    )
    run = running_totals(levels, "freq", ["n"])
    n, before, f = F.col("n"), F.col("n_before"), F.col("freq").cast("double")
    # places before+1 .. before+n share one frequency
    places = n * before + n * (n + 1) / 2
    total = F.sum(n * f)
    size = F.max("n_total")
    weighted = F.sum(2 * places * f) - (size + 1) * total
    return run.agg(F.coalesce(F.try_divide(weighted, size * total), F.lit(0.0)).alias("gini"))


def invisible_items(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue items that are on no list."""
    return catalog.select("item").distinct().join(recs.select("item").distinct(), "item", "left_anti")


def precision_by_profile(recs: DataFrame, truth: DataFrame, profiles: DataFrame, k: int = 10) -> DataFrame:
    per_user = user_measures(recs, truth, [k]).join(profiles, "usuario_id", "left")
    label = F.coalesce("perfil", F.lit("UnknownProfile"))
    return per_user.groupBy(label.alias("perfil")).agg(F.avg(f"precision_{k}").alias("precision"))


def error_report(
    recs: DataFrame, truth: DataFrame, catalog: DataFrame, popularity: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Bias, inequality, never-listed count and precision per profile as (metrica, valor)."""
    recs = cut_lineage(recs)  # four measures read the lists
    by_profile = precision_by_profile(recs, truth, profiles)
    parts = [
        popularity_bias(recs, popularity).select(F.lit("popularity_bias").alias("metrica"), F.col("vies").alias("valor")),
        gini(recs, catalog).select(F.lit("gini"), "gini"),
        invisible_items(recs, catalog).agg(F.count("*").cast("double").alias("n")).select(F.lit("invisible_items"), "n"),
        by_profile.select(F.concat(F.lit("precision:"), "perfil"), "precision"),
    ]
    return reduce(DataFrame.union, parts)


def coverage_curve(recs: DataFrame, sizes: Sequence[int], seed: int = 42) -> DataFrame:
    """Distinct items over growing, nested user samples drawn in one seeded order."""
    users = recs.select("usuario_id").distinct()
    # the largest sample size bounds the rows that are ranked
    order = [draw(F.col("usuario_id"), seed), F.col("usuario_id")]
    chosen = users.orderBy(*order).limit(max(sizes))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    ranked = chosen.withColumn("place", place)
    first = recs.join(ranked, "usuario_id").groupBy("item").agg(F.min("place").alias("first"))
    counts = first.agg(*[F.count_if(F.col("first") <= n).alias(f"s{n}") for n in sizes])
    rows = F.array(*[F.struct(F.lit(n).alias("n_usuarios"), F.col(f"s{n}").alias("itens")) for n in sizes])
    total = users.agg(F.count("*").alias("t"))
    return counts.select(F.inline(rows)).join(F.broadcast(total)).where("n_usuarios <= t").drop("t")


def with_percent(curve: DataFrame, catalog: DataFrame) -> DataFrame:
    size = catalog.agg(F.count_distinct("item").alias("n"))
    return curve.join(F.broadcast(size)).select(
        "n_usuarios", "itens", (F.col("itens") / F.col("n") * 100).alias("cobertura_pct")
    )


def power_law(curve: DataFrame) -> DataFrame:
    """ln(coverage) = a ln(n) + b with R2, residual deviation and sample size."""
    pts = curve.where("cobertura_pct > 0").select(
        F.log("n_usuarios").alias("x"), F.log("cobertura_pct").alias("y")
    )
    out = pts.agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "x").alias("a"),
        F.regr_intercept("y", "x").alias("b"),
        F.regr_r2("y", "x").alias("r2"),
        F.regr_syy("y", "x").alias("syy"),
    )
    se = F.sqrt(F.greatest(F.try_divide((1 - F.col("r2")) * F.col("syy"), F.col("n") - 2), F.lit(0.0)))
    return out.select("n", "a", "b", "r2", se.alias("se"))


def users_needed(fit: DataFrame, target_pct: float = 15.0) -> DataFrame:
    """Users needed for a coverage target by the fitted law."""
    need = F.exp(F.try_divide(F.log(F.lit(target_pct)) - F.col("b"), F.col("a")))
    return fit.select(F.lit(target_pct).alias("alvo_pct"), need.alias("n_usuarios"))


def coverage_projection(fit: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Projected coverage with a 95 % band for user counts beyond the curve."""
    mid = F.col("a") * F.log("n_usuarios") + F.col("b")
    return fit.withColumn("n_usuarios", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes]))).select(
        "n_usuarios",
        F.exp(mid).alias("central"),
        F.exp(mid - 1.96 * F.col("se")).alias("inferior"),
        F.exp(mid + 1.96 * F.col("se")).alias("superior"),
    )


def acceptance_rate(recs: DataFrame, threshold: float = 0.5) -> DataFrame:
    share = F.avg((F.col("score") >= threshold).cast("double"))
    return recs.agg(F.coalesce(share, F.lit(0.0)).alias("aceitacao"))


def expected_ctr(recs: DataFrame) -> DataFrame:
    """Mean click chance of the listed scores."""
    s = F.col("score")
    chance = F.when(s > 0.7, CLICK_HIGH).when(s >= 0.5, CLICK_MID).otherwise(CLICK_LOW)
    return recs.agg(F.coalesce(F.avg(chance), F.lit(0.0)).alias("ctr"))


def expected_session_minutes(
    recs: DataFrame, item_genre: DataFrame, base: Mapping[str, float] | None = None, default: float = DEFAULT_SESSION_TIME
) -> DataFrame:
    """Mean base minutes of the genre over accepted positions (score >= 0.5)."""
    base = GENRE_BASE_SESSION_TIME if base is None else base
    minutes = F.create_map(*[F.lit(v) for kv in base.items() for v in kv])
    hits = recs.where(F.col("score") >= 0.5).groupBy("item").agg(F.count("*").alias("n")).join(item_genre, "item", "left")
    looked = F.coalesce(F.try_element_at(minutes, F.col("genero")), F.lit(default))
    return hits.agg(F.coalesce(F.try_divide(F.sum(looked * F.col("n")), F.sum("n")), F.lit(0.0)).alias("minutos"))


def log_metrics(metrics: DataFrame, run: str, path: str) -> None:
    """Append (run, metrica, valor) rows to a metrics table."""
    metrics.select(F.lit(run).alias("run"), "metrica", "valor").write.mode("append").parquet(path)
