"""Registered list-quality queries on the segment lists and the later purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import sampling as S
from acervo.operators import evaluate as E
from acervo.plans import bindings as B
from acervo.plans.bindings import with_views
from acervo.plans.market_queries import r
from acervo.plans.registry import register

HITS = """hits AS (SELECT r.usuario_id, r.rank, r.item, r.score, (t.item IS NOT NULL)::INT AS hit, coalesce(n, 0) AS n
    FROM recs r LEFT JOIN truth t ON t.usuario_id = r.usuario_id AND t.item = r.item
    LEFT JOIN (SELECT usuario_id, count(*) AS n FROM truth GROUP BY 1) c ON c.usuario_id = r.usuario_id),
run AS (SELECT *, sum(hit) OVER (PARTITION BY usuario_id ORDER BY rank) AS sofar FROM hits)"""


def _per_user(k: int) -> str:
    ideal = f"(SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, {k} + 1) x(i) WHERE i <= n)"
    return f"""u{k} AS (SELECT usuario_id, sum(hit) FILTER (WHERE rank <= {k}) / {k}.0::DOUBLE AS p,
        CASE WHEN n > 0 THEN sum(hit) FILTER (WHERE rank <= {k}) / n::DOUBLE ELSE 0 END AS rc,
        CASE WHEN n > 0 THEN sum(hit / log2(rank + 1)) FILTER (WHERE rank <= {k}) / (SELECT g FROM ideal WHERE kk = least(n, {k})) ELSE 0 END AS nd,
        CASE WHEN n > 0 THEN sum(hit * sofar / rank::DOUBLE) FILTER (WHERE rank <= {k}) / least(n, {k}) ELSE 0 END AS ap,
        coalesce(max(CASE WHEN hit = 1 THEN 1.0::DOUBLE / rank END), 0) AS rr
        FROM run GROUP BY usuario_id, n)"""


IDEAL = """ideal AS (SELECT kk, sum(1.0::DOUBLE / log2(i + 1)) AS g
    FROM range(1, 21) a(kk), range(1, 21) b(i) WHERE i <= kk GROUP BY kk)"""


def _sql(select: str, *ks: int) -> str:
    return with_views("WITH " + ",\n".join([HITS, IDEAL, *map(_per_user, ks)]) + "\n" + select, "recs", "truth", "supplier_catalog")


def _one(name: str, ids: str, k: int, col: str, fn, alias: str) -> None:
    register(name, ids, _sql(f"SELECT round(avg({col}), 6) AS {alias} FROM u{k}", k))(
        lambda s, d: fn(B.recs(s, d), B.truth(s, d)).select(r(alias)))


_one("precision_at_10", "E-01 W-03", 10, "p", lambda x, t: E.precision_at_k(x, t, 10), "precision")
_one("recall_at_10", "E-02", 10, "rc", lambda x, t: E.recall_at_k(x, t, 10), "recall")
_one("map_at_20", "E-03 W-07", 20, "ap", lambda x, t: E.map_at_k(x, t, 20), "map")
_one("ndcg_at_10", "E-04", 10, "nd", lambda x, t: E.ndcg_at_k(x, t, 10), "ndcg")
_one("mean_reciprocal_rank", "E-05", 20, "rr", E.mrr, "mrr")


@register("user_measures", "E-01 E-02 E-03 E-04 E-05", _sql("""
    SELECT usuario_id, p AS precision_10, round(rc, 6) AS recall_10, round(nd, 6) AS ndcg_10,
           round(ap, 6) AS ap, round(rr, 6) AS rr FROM u10""", 10))
def _(s, d):
    out = E.user_measures(B.recs(s, d), B.truth(s, d), [10])
    return out.select("usuario_id", "precision_10", r("recall_10"), r("ndcg_10"), r("ap"), r("rr"))


@register("coverage", "E-06", with_views("""
    SELECT count(DISTINCT item) AS itens,
           round(count(DISTINCT item) / (SELECT count(*) FROM supplier_catalog)::DOUBLE, 6) AS cobertura FROM recs""",
    "recs", "supplier_catalog"))
def _(s, d):
    return E.coverage(B.recs(s, d), B.supplier_catalog(s, d)).select("itens", r("cobertura"))


_REPORT = "\nUNION ALL ".join(
    f"SELECT '{m}_{k}' AS metrica, round(avg({c}), 6) AS valor FROM u{k}"
    for k in (5, 10, 20) for m, c in (("precision", "p"), ("recall", "rc"), ("ndcg", "nd")))


@register("offline_report", "E-07", _sql(_REPORT + """
    UNION ALL SELECT 'map', round(avg(ap), 6) FROM u20 UNION ALL SELECT 'mrr', round(avg(rr), 6) FROM u20
    UNION ALL SELECT 'coverage', round(count(DISTINCT item) / (SELECT count(*) FROM supplier_catalog)::DOUBLE, 6) FROM recs""", 5, 10, 20))
def _(s, d):
    return E.offline_report(B.recs(s, d), B.truth(s, d), B.supplier_catalog(s, d)).select("metrica", r("valor"))


@register("popularity_bias", "E-09", with_views("""
    SELECT round(corr(f, popularidade), 6) AS vies FROM (SELECT item, count(*) AS f FROM recs GROUP BY 1)
    JOIN popularity USING (item)""", "recs", "popularity"))
def _(s, d):
    return E.popularity_bias(B.recs(s, d), B.popularity(s, d)).select(r("vies"))


GINI = """f AS (SELECT c.item, count(r.item) AS f FROM supplier_catalog c LEFT JOIN recs r ON r.item = c.item GROUP BY 1),
o AS (SELECT f, row_number() OVER (ORDER BY f, item) AS i, count(*) OVER () AS n FROM f)"""
GINI_VALUE = "sum((2 * i - n - 1) * f) / (max(n) * sum(f))::DOUBLE"


@register("gini", "E-10 W-08", with_views(f"WITH {GINI} SELECT round({GINI_VALUE}, 6) AS gini FROM o", "recs", "supplier_catalog"))
def _(s, d):
    return E.gini(B.recs(s, d), B.supplier_catalog(s, d)).select(r("gini"))


@register("invisible_items", "E-11 J-05 U-05", with_views("""
    SELECT item FROM supplier_catalog EXCEPT SELECT item FROM recs""", "recs", "supplier_catalog"))
def _(s, d):
    return E.invisible_items(B.recs(s, d), B.supplier_catalog(s, d))


@register("precision_by_profile", "E-12 A-25", _sql("""
    SELECT coalesce(c_mktsegment, 'UnknownProfile') AS perfil, round(avg(p), 6) AS precision
    FROM u10 LEFT JOIN customer ON c_custkey = usuario_id GROUP BY 1""", 10))
def _(s, d):
    out = E.precision_by_profile(B.recs(s, d), B.truth(s, d), B.profiles(s, d))
    return out.select("perfil", r("precision"))


@register("error_report", "E-13", with_views("WITH " + ",\n".join([HITS, IDEAL, _per_user(10), GINI]) + f"""
    SELECT 'popularity_bias' AS metrica, round(corr(f, popularidade), 6) AS valor
    FROM (SELECT item, count(*) AS f FROM recs GROUP BY 1) JOIN popularity USING (item)
    UNION ALL SELECT 'gini', round({GINI_VALUE}, 6) FROM o
    UNION ALL SELECT 'invisible_items', count(*)::DOUBLE FROM f WHERE f = 0
    UNION ALL SELECT 'precision:' || c_mktsegment, round(avg(p), 6) FROM u10 JOIN customer ON c_custkey = usuario_id GROUP BY c_mktsegment""",
    "recs", "truth", "supplier_catalog", "popularity"))
def _(s, d):
    out = E.error_report(B.recs(s, d), B.truth(s, d), B.supplier_catalog(s, d), B.popularity(s, d), B.profiles(s, d))
    return out.select("metrica", r("valor"))


# item lists that differ per user: the suppliers a user bought from before the cut
OWN = f"""own AS (SELECT usuario_id, item, row_number() OVER (PARTITION BY usuario_id ORDER BY n DESC, item) AS rank FROM (
    SELECT o_custkey AS usuario_id, l_suppkey AS item, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate < TIMESTAMP '{B.CUT}' GROUP BY 1, 2) QUALIFY rank <= 10)"""
SIZES = [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000]


def own_lists(s, d):
    counts = B._sales(s, d).where(F.col("o_orderdate") < F.lit(B.CUT).cast("timestamp_ntz")).groupBy(
        F.col("o_custkey").alias("usuario_id"), F.col("l_suppkey").alias("item")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W
    best = W.partitionBy("usuario_id").orderBy(F.desc("n"), "item")
    return counts.withColumn("rank", F.row_number().over(best)).where("rank <= 10").select("usuario_id", "item", "rank")


CURVE = OWN + f""",
ur AS (SELECT usuario_id, row_number() OVER (ORDER BY ('0x' || left(md5(CAST(usuario_id AS VARCHAR) || ':42'), 15))::BIGINT, usuario_id) AS pl
       FROM (SELECT DISTINCT usuario_id FROM own)),
fs AS (SELECT item, min(pl) AS pl FROM own JOIN ur USING (usuario_id) GROUP BY 1),
cv AS (SELECT s::INT AS n_usuarios, (SELECT count(*) FROM fs WHERE pl <= s) AS itens
       FROM (SELECT unnest({SIZES}) AS s) WHERE s <= (SELECT count(*) FROM ur)),
pt AS (SELECT n_usuarios, itens, itens * 100.0::DOUBLE / (SELECT count(*) FROM supplier_catalog) AS pct FROM cv),
ft AS (SELECT count(*) AS n, regr_slope(ln(pct), ln(n_usuarios)) AS a, regr_intercept(ln(pct), ln(n_usuarios)) AS b,
       regr_r2(ln(pct), ln(n_usuarios)) AS r2,
       sqrt((1 - regr_r2(ln(pct), ln(n_usuarios))) * regr_syy(ln(pct), ln(n_usuarios)) / (count(*) - 2)) AS se FROM pt)"""


def _curve(s, d):
    return E.with_percent(E.coverage_curve(own_lists(s, d), SIZES), B.supplier_catalog(s, d))


@register("coverage_curve", "E-14 O-09", with_views(
    f"WITH {CURVE} SELECT n_usuarios, itens, round(pct, 6) AS cobertura_pct FROM pt", "supplier_catalog"))
def _(s, d):
    return _curve(s, d).select("n_usuarios", "itens", r("cobertura_pct"))


@register("coverage_power_law", "E-15", with_views(f"""WITH {CURVE}
    SELECT n, round(a, 6) AS a, round(b, 6) AS b, round(r2, 6) AS r2, round(se, 6) AS se FROM ft""", "supplier_catalog"))
def _(s, d):
    return E.power_law(_curve(s, d)).select("n", r("a"), r("b"), r("r2"), r("se"))


@register("coverage_projection", "E-15", with_views(f"""WITH {CURVE}
    SELECT m AS n_usuarios, round(exp(a * ln(m) + b), 4) AS central, round(exp(a * ln(m) + b - 1.96 * se), 4) AS inferior,
           round(exp(a * ln(m) + b + 1.96 * se), 4) AS superior
    FROM ft, (SELECT unnest([100000, 500000, 1000000]::BIGINT[]) AS m)""", "supplier_catalog"))
def _(s, d):
    out = E.coverage_projection(E.power_law(_curve(s, d)), [100000, 500000, 1000000])
    return out.select("n_usuarios", r("central", 4), r("inferior", 4), r("superior", 4))


@register("coverage_users_needed", "E-15", with_views(f"""WITH {CURVE}
    SELECT 15.0::DOUBLE AS alvo_pct, round(exp((ln(15) - b) / nullif(a, 0)), 6) AS n_usuarios FROM ft""", "supplier_catalog"))
def _(s, d):
    return E.users_needed(E.power_law(_curve(s, d))).select("alvo_pct", r("n_usuarios"))


@register("acceptance_rate", "E-16", with_views(
    "SELECT round(avg((score >= 0.5)::INT), 6) AS aceitacao FROM recs", "recs"))
def _(s, d):
    return E.acceptance_rate(B.recs(s, d)).select(r("aceitacao"))


@register("expected_ctr", "E-17", with_views("""
    SELECT round(avg(CASE WHEN score > 0.7 THEN 0.30::DOUBLE WHEN score >= 0.5 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END), 6) AS ctr
    FROM recs""", "recs"))
def _(s, d):
    return E.expected_ctr(B.recs(s, d)).select(r("ctr"))


@register("expected_session_minutes", "E-18 J-06", with_views("""
    SELECT round(avg(CASE item % 9 WHEN 0 THEN 372 WHEN 1 THEN 304 WHEN 2 THEN 294 WHEN 3 THEN 210 WHEN 4 THEN 250
                 WHEN 5 THEN 180 WHEN 6 THEN 90 ELSE 120 END), 6) AS minutos FROM recs WHERE score >= 0.5""", "recs"))
def _(s, d):
    names = F.array(*[F.lit(g) for g in ("MMO", "RPG", "Strategy", "Action", "Simulation", "Adventure", "Casual", "Other", "None")])
    genre = B.supplier_catalog(s, d).select("item", F.element_at(names, (F.col("item") % 9 + 1).cast("int")).alias("genero"))
    return E.expected_session_minutes(B.recs(s, d), genre).select(r("minutos"))


@register("fraction_split", "O-07 J-05", """
    SELECT o_orderkey, CASE WHEN ('0x' || left(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 15))::BIGINT < 807045053224792832 THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(s, d):
    a, b = S.split_frac(B.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 0.7)
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))


STRAT = """(SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || left(md5(CAST(doc_id AS VARCHAR) || ':42'), 15))::BIGINT, doc_id) AS i,
             count(*) OVER (PARTITION BY quality) AS n FROM labels)"""


@register("stratified_split", "O-08 M-02", f"""
    SELECT doc_id, quality, CASE WHEN i <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {STRAT}""")
def _(s, d):
    return S.split_stratified(B.table(s, d, "labels").select("doc_id", "quality"), "doc_id", ["quality"])


@register("stratified_split_three", "O-08", f"""
    SELECT doc_id, quality, CASE WHEN i <= t THEN 'test' WHEN i <= t + round((n - t) * 0.125::DOUBLE) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, round(n * 0.2::DOUBLE) AS t FROM {STRAT})""")
def _(s, d):
    return S.split_stratified(B.table(s, d, "labels").select("doc_id", "quality"), "doc_id", ["quality"], 0.2, 0.125)


@register("seeded_sample", "O-06", """
    SELECT o_orderkey, o_custkey FROM orders ORDER BY ('0x' || left(md5(CAST(o_orderkey AS VARCHAR) || ':42'), 15))::BIGINT, o_orderkey LIMIT 2000""")
def _(s, d):
    return S.sample_n(B.table(s, d, "orders").select("o_orderkey", "o_custkey"), 2000, "o_orderkey")
