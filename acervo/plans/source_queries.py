"""Registered reads and writes: each query stores a table in the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions.sampling import split_stratified
from acervo.operators import evaluate as E, features as FE, market as MK, models as M, stats as T
from acervo.plans import bindings as B
from acervo.plans.bindings import with_views
from acervo.plans.evaluate_queries import GINI, GINI_VALUE, STRAT
from acervo.plans.market_queries import r
from acervo.plans.model_queries import ENG, _labelled
from acervo.plans.registry import register
from acervo.session import scratch
from acervo.sources import summary as SU, tables as S


@register("csv_round_trip", "S-01 S-04", "SELECT doc_id, md5(text) AS digest, lang, source FROM documents")
def _(s, d):
    path = scratch(s, "csv")
    S.write_csv(B.table(s, d, "documents").select("doc_id", "text", "lang", "source"), path)
    back = S.read_catalog_csv(s, path, "doc_id bigint, text string, lang string, source string")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@register("split_files", "S-05 S-03", f"""
    SELECT doc_id, quality, CASE WHEN i <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {STRAT}""")
def _(s, d):
    path = scratch(s, "splits")
    S.write_splits(split_stratified(B.table(s, d, "labels").select("doc_id", "quality"), "doc_id", ["quality"]), path)
    return S.read_training_set(s, path).select("doc_id", "quality", "split")


@register("reloaded_orders", "S-09", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    path = scratch(s, "reload")
    orders = B.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    S.reload(orders, path)
    S.reload(orders.where("o_orderstatus = 'F'"), path)
    return s.read.parquet(path).select("o_orderkey", "o_custkey")


@register("versioned_customers", "S-10", """
    SELECT c_custkey, 1 AS version FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_mktsegment = 'BUILDING'""")
def _(s, d):
    path = scratch(s, "versions")
    rows = B.table(s, d, "customer").select("c_custkey", "c_mktsegment")
    S.write_version(rows, path)
    S.write_version(rows.where("c_mktsegment = 'BUILDING'"), path)
    return s.read.parquet(path).select("c_custkey", "version")


@register("price_summary_table", "S-14 A-01a", with_views("""
    SELECT nome, round(avg(preco_base), 6) AS preco_medio, count(id) AS total_jogos
    FROM games JOIN game_categories ON id = jogo_id GROUP BY nome""", "games", "game_categories"))
def _(s, d):
    out = S.materialize(MK.price_by_category(B.games(s, d), B.game_categories(s, d)), scratch(s, "summary"))
    return out.select("nome", r("preco_medio"), "total_jogos")


@register("price_summary_batches", "S-14 A-01a", with_views("""
    SELECT nome, count(preco_base) AS total, round(avg(preco_base), 6) AS media, round(stddev_samp(preco_base), 6) AS desvio,
           min(preco_base) AS menor, max(preco_base) AS maior
    FROM games JOIN game_categories ON id = jogo_id GROUP BY nome""", "games", "game_categories"))
def _(s, d):
    """Prices per category by a summary that was refreshed with three batches, one of them twice."""
    path = scratch(s, "batches")
    rows = B.games(s, d).join(B.game_categories(s, d), F.col("id") == F.col("jogo_id")).select("nome", "preco_base", (F.col("id") % 3).alias("lote"))
    for batch in (0, 1, 1, 2):
        SU.refresh_summary(rows.where(F.col("lote") == batch), path, ["nome"], "preco_base", f"lote {batch}")
    return SU.read_summary(s, path, ["nome"]).select("nome", "total", r("media"), r("desvio"), "menor", "maior")


@register("metrics_log", "E-19", with_views(f"""WITH {GINI}
    SELECT 'first' AS run, 'gini' AS metrica, round({GINI_VALUE}, 6) AS valor FROM o
    UNION ALL SELECT 'second', 'cobertura', round(count(DISTINCT item) / (SELECT count(*) FROM supplier_catalog)::DOUBLE, 6) FROM recs""",
    "recs", "supplier_catalog"))
def _(s, d):
    path = scratch(s, "metrics")
    recs, catalog = B.recs(s, d), B.supplier_catalog(s, d)
    E.log_metrics(E.gini(recs, catalog).select(F.lit("gini").alias("metrica"), F.col("gini").alias("valor")), "first", path)
    cover = E.coverage(recs, catalog).select(F.lit("cobertura").alias("metrica"), F.col("cobertura").alias("valor"))
    E.log_metrics(cover, "second", path)
    return s.read.parquet(path).select("run", "metrica", r("valor"))


@register("enforced_types", "T-08 X-16", with_views("""
    SELECT "AppID", CASE WHEN "AppID" % 5 <> 0 THEN round("Price", 6) END AS price, "AppID"::VARCHAR AS notes FROM catalog""", "catalog"))
def _(s, d):
    i = F.col("AppID")
    raw = B.catalog(s, d).withColumn("Notes", i).withColumn("Price", F.when(i % 5 != 0, F.col("Price").cast("string")).otherwise("n/a"))
    out = T.enforce_types(raw)
    return out.select("AppID", F.round("Price", 6).alias("price"), F.col("Notes").alias("notes"))


@register("user_condition_base", "F-08 F-05 F-06 F-07 J-09", with_views(f"""WITH {ENG},
    h AS (SELECT usuario_id, avg(hour(inicio)) AS mh FROM sessions GROUP BY 1)
    SELECT u.id AS usuario_id, round(coalesce((f - (SELECT min(f) FROM en)) / (SELECT max(f) - min(f) FROM en), 0), 6) AS session_frequency,
           round(coalesce((g - (SELECT min(g) FROM en)) / (SELECT max(g) - min(g) FROM en)::DOUBLE, 0), 6) AS unique_games_norm,
           coalesce((h >= (SELECT quantile_cont(h, 0.95) FROM en))::INT, 0) AS is_outlier,
           round(coalesce(cos(2 * pi() * mh / 24), 0), 6) AS hora_cos, round(coalesce(sin(2 * pi() * mh / 24), 0), 6) AS hora_sin,
           CASE WHEN h > 0 THEN 1 ELSE 0 END::DOUBLE AS shares
    FROM users u LEFT JOIN en ON en.usuario_id = u.id LEFT JOIN h ON h.usuario_id = u.id""", "users", "sessions"))
def _(s, d):
    out = FE.user_condition(B.sessions(s, d), B.games(s, d), B.game_categories(s, d), B.users(s, d), B.as_of())
    known = ["usuario_id", "session_frequency", "unique_games_norm", "is_outlier", "hora_cos", "hora_sin"]
    shares = sum((F.col(f"`{c}`") for c in out.columns if c not in known), F.lit(0.0))
    return out.select("usuario_id", r("session_frequency"), r("unique_games_norm"), "is_outlier", r("hora_cos"), r("hora_sin"),
                      F.round(shares, 6).alias("shares"))


@register("saved_forest", "M-13", with_views("SELECT count(*) AS linhas, 0 AS diferentes FROM games", "games"))
def _(s, d):
    """Rows whose prediction differs between a model and the same model saved and loaded."""
    path = scratch(s, "forest")
    rows = _labelled(s, d)
    model = M.train_quality_rf(rows.where("split = 'train'"))
    M.save_model(model, path)
    before = M.predict_quality(model, rows).select("id", F.col("probabilidade").alias("antes"))
    both = M.predict_quality(M.load_model(path), rows).join(before, "id")
    return both.agg(F.count("*").alias("linhas"), F.count_if(F.col("antes") != F.col("probabilidade")).cast("int").alias("diferentes"))
