"""Cases that went wrong once: infinities, clashing names, many genres, limits that cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.functions.prefix import average_ranks, exact_quantiles
from acervo.functions.scalars import capitalized
from acervo.operators import evaluate as E, features as FE, impute as I, recommend as R, stats as S
from acervo.sources import tables as T


@pytest.mark.parametrize("values", [[-math.inf] * 5 + [1.0, 2.0], [math.inf, *map(float, range(10))], [-math.inf, math.inf], [math.inf] * 4])
def test_infinities_are_ranked(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["avg_rank"] for r in average_ranks(df, "v").collect()}
    ordered = sorted(values)
    want = {v: np.mean([i + 1 for i, w in enumerate(ordered) if w == v]) for v in set(values)}
    assert got == want


def test_median_beside_an_infinity(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.inf,)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).first()["m"] == 2.0


def test_partial_correlation_stays_within_one(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i, float((i * 7) % 5)) for i in range(40)], "x double, y double, z double")
    got = S.partial_corr(df, "x", "y", "z").first()
    assert got["r"] <= 1.0 and got["p"] is not None and got["p"] < 1e-6


def test_flags_of_categories_that_look_alike(spark):
    names = FE.flag_names(["Co-op", "Co op", "co op", "RPG", "RPG"])
    assert len(names) == 4 and len({n.lower() for n in names.values()}) == 4
    assert names["Co-op"] == "cat_Co_op" and names["RPG"] == "cat_RPG"


def genre_tables(spark, n):
    games = spark.range(n).select("id")
    bridge = spark.range(n).select(F.col("id").alias("jogo_id"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("nome"))
    sessions = spark.range(n).select((F.col("id") % 7).alias("usuario_id"), F.col("id").alias("jogo_id"), F.lit(2.0).alias("horas_jogadas"))
    return sessions, games, bridge


def test_shares_of_three_thousand_genres(spark):
    rows = FE.genre_share_rows(*genre_tables(spark, 3000))
    assert rows.count() == 3000
    sums = [r["s"] for r in rows.groupBy("usuario_id").agg(F.sum("share").alias("s")).collect()]
    assert len(sums) == 7 and all(abs(s - 1) < 1e-9 for s in sums)


def test_a_genre_named_unknown(spark):
    sessions, games, bridge = genre_tables(spark, 5)
    bridge = bridge.withColumn("nome", F.when(F.col("jogo_id") == 1, "Unknown").otherwise(F.col("nome")))
    wide = FE.user_genre_share(sessions, games, bridge)
    assert wide.columns.count("Unknown") == 1 and wide.count() == 5


def test_long_names_are_kept(spark):
    df = spark.createDataFrame([("x" * 500,)], "t string")
    assert df.select(capitalized(F.col("t"))).first()[0] == "X" + "x" * 499


def test_one_key_with_half_of_the_rows(spark):
    recs = spark.range(4000).select(F.col("id").alias("usuario_id"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("item"), F.lit(0.9).alias("score"))
    catalog = spark.range(60).select(F.col("id").alias("item"))
    hidden = E.invisible_items(recs, catalog)
    assert sorted(r["item"] for r in hidden.collect()) == [i for i in range(1, 60) if i >= 50 or i % 2 == 0]
    assert "HashAggregate(keys=[item" in hidden._jdf.queryExecution().executedPlan().toString()
    genre = catalog.withColumn("genero", F.lit("RPG"))
    assert E.expected_session_minutes(recs, genre).first()["minutos"] == E.expected_session_minutes(recs.limit(1), genre).first()["minutos"]
    target = recs.select(F.col("item").alias("k"))
    new = spark.range(60).select(F.col("id").alias("k"))
    assert T.insert_ignore(target, new, ["k"]).count() == hidden.count()


def test_all_items_above_a_threshold(spark):
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(6, 3)), rng.normal(size=(90, 3))
    users = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(u)], "usuario_id bigint, vetor array<double>")
    items = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(v)], "id bigint, vetor array<double>")
    for threshold in (0.1, 2.0, 50.0):
        got = {(r["usuario_id"], r["item"]) for r in R.items_above(users, items, threshold, 3).collect()}
        want = set()
        for i, s in enumerate(u @ v.T):
            hits = np.flatnonzero(s >= threshold)
            want |= {(i, j) for j in (hits if len(hits) else sorted(range(90), key=lambda j: (-s[j], j))[:6])}
        assert got == want


def test_cosine_compares_all_known_texts(spark):
    known = spark.createDataFrame([(i, f"word{i} common", f"p{i}") for i in range(700)], "AppID bigint, g string, p string")
    asked = spark.createDataFrame([(1000 + i, f"word{i}") for i in range(0, 700, 50)], "AppID bigint, g string")
    got = {r["AppID"]: r["previsto"] for r in I.cosine_nearest(asked, known, "g", "p").collect()}
    assert got == {1000 + i: f"p{i}" for i in range(0, 700, 50)}


def test_capitals_letter_for_letter_as_in_sql(spark):
    """A first letter without a single common capital, a sigma at the end of a word, an I with a dot; as DuckDB has them."""
    import duckdb

    texts = ["\u00dfieung", "\ufb01eld", "\u1fb3x", "x\u03a3 \u0391\u03a3", "a\u0130b", "\u0130a", "\u03a3x", "", " "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(capitalized(F.col("t"))).collect()]
    sql = "SELECT upper(substr(trim(t, ' '), 1, 1)) || lower(substr(trim(t, ' '), 2)) FROM (SELECT ?::VARCHAR AS t)"
    assert got == [duckdb.connect().execute(sql, [t]).fetchone()[0] for t in texts]


def test_a_task_of_the_library_does_not_grow_with_the_input(spark, sf, monkeypatch):
    from acervo import session
    from acervo.plans import bindings as B

    monkeypatch.setattr(session, "PIECE_ROWS", 500)
    rows = B.library(spark, sf)
    lines = B.table(spark, sf, "lineitem").count()
    parts = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= lines // 600 and max(r["count"] for r in parts) < 1000
    assert sum(r["count"] for r in parts) == rows.select("usuario_id", "jogo_id").distinct().count()
