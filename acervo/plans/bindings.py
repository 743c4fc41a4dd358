"""The entity model bound to the driver tables, in Spark and as SQL views.

Each view exists twice: a DataFrame function here and a common table
expression for the SQL twin. Fractional literals are DOUBLE on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from acervo.session import dealt

AS_OF = "2001-08-01 00:00:00"
CUT = "2000-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def games(spark: SparkSession, d: str) -> DataFrame:
    sold = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_partkey").alias("id"))
        .agg(
            F.count_if(F.col("l_returnflag") != "R").alias("pos"),
            F.count_if(F.col("l_returnflag") == "R").alias("neg"),
            F.min("l_suppkey").alias("desenvolvedor_id"),
            F.min("l_shipdate").alias("data_lancamento"),
            F.count_if(F.col("l_discount") >= 0.10).alias("achievements"),
            F.sum("l_quantity").alias("playtime"),
        )
    )
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("titulo"), "p_size"
    )
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    return part.join(sold, "id", "left").select(
        "id",
        "titulo",
        ((F.col("p_size") - 1) * F.lit(2.0)).alias("preco_base"),
        pos.alias("pos"),
        neg.alias("neg"),
        (F.lit(5.0) * pos / (pos + neg + 1)).alias("avaliacao_media"),
        (pos + neg).alias("total_avaliacoes"),
        (F.col("p_size") % 19).alias("idade_requerida"),
        (F.col("p_size") * 2).alias("metacritic_score"),
        "desenvolvedor_id",
        "data_lancamento",
        F.coalesce("achievements", F.lit(0)).alias("achievements"),
        "playtime",
    )


def game_categories(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("jogo_id"),
        F.explode(F.array("p_brand", "p_type")).alias("nome"),
    )


def achievements(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_discount") >= 0.10)
        .select(F.col("l_partkey").alias("jogo_id"))
    )


def _nations(spark: SparkSession, d: str) -> DataFrame:
    # one row per country: bounded by the world, not by the data
    return F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("pais")))


def developers(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "supplier")
        .join(_nations(spark, d), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nome"), "pais")
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "customer")
        .join(_nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("id"), "pais", F.col("c_mktsegment").alias("tipo_assinatura")
        )
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Play sessions; ``horas_jogadas`` is null on every seventh line."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
    )
    inicio = F.col("o_orderdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 3)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("usuario_id"),
        F.col("l_partkey").alias("jogo_id"),
        inicio.alias("inicio"),
        (inicio + F.make_dt_interval(hours=F.col("l_quantity").cast("int"))).alias("fim"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("horas_jogadas"),
    )


def library(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("usuario_id"), F.col("l_partkey").alias("jogo_id"), "l_extendedprice"
    )
    # nearly every pair is there once: folding in the join's tasks would only take their memory
    return dealt(bought, lines.count(), "usuario_id", "jogo_id").groupBy("usuario_id", "jogo_id").agg(F.max("l_extendedprice").alias("preco_pago"))


def _sales(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def recs(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best-selling suppliers of a segment before the cut, for each of its users."""
    who = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    counts = (
        _sales(spark, d)
        .where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count("*").alias("n"))
        .join(who, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "l_suppkey")
        .agg(F.sum("n").alias("n"))
    )
    best = W.partitionBy("c_mktsegment").orderBy(F.desc("n"), "l_suppkey")
    top = (
        counts.withColumn("rank", F.row_number().over(best))
        .where("rank <= 20")
        .withColumn("score", F.col("n") / F.max("n").over(W.partitionBy("c_mktsegment")))
        .select("c_mktsegment", "rank", F.col("l_suppkey").alias("item"), "score")
    )
    return who.join(top, "c_mktsegment").select(
        F.col("c_custkey").alias("usuario_id"), "rank", "item", "score"
    )


def truth(spark: SparkSession, d: str) -> DataFrame:
    return (
        _sales(spark, d)
        .where(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz"))
        .select(F.col("o_custkey").alias("usuario_id"), F.col("l_suppkey").alias("item"))
        .distinct()
    )


def popularity(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("item"))
        .agg(F.count("*").alias("popularidade"))
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("usuario_id"), F.col("c_mktsegment").alias("perfil")
    )


def supplier_catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vetor")
    )


def emb_users(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("id % 5 = 0").select(
        "id", F.transform("vetor", lambda x: x * F.lit(3.0)).alias("vetor")
    )


def emb_items(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("id % 5 <> 0")


def emb_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every vector id asks for recommendations; those without a user vector are cold."""
    return _vectors(spark, d).select(F.col("id").alias("usuario_id"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Documents seen as an incomplete raw catalogue; hidden values kept as ``real_*``."""
    i = F.col("doc_id")
    both = F.concat("lang", F.lit(","), "source")
    return table(spark, d, "documents").select(
        i.alias("AppID"),
        F.concat("source", F.lit(" "), (i % 50).cast("string")).alias("Name"),
        F.col("text").alias("About the game"),
        F.when(i % 10 != 0, F.col("lang")).alias("Genres"),
        F.when(i % 7 != 0, F.col("source")).alias("Tags"),
        F.when(i % 9 != 0, both).alias("Categories"),
        F.col("source").alias("Developers"),
        F.when(i % 4 != 0, F.col("source")).alias("Publishers"),
        F.lit(None).cast("string").alias("Notes"),
        ((F.col("n_chars") % 6000) / F.lit(100.0) - 1).alias("Price"),
        (F.col("n_chars") % 101).cast("double").alias("Metacritic score"),
        F.col("lang").alias("real_genres"),
        F.col("source").alias("real_tags"),
        both.alias("real_categories"),
    )


def raw_games(spark: SparkSession, d: str) -> DataFrame:
    """Games under the raw catalogue's column names, with multi-value texts."""
    cats = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat("p_brand", F.lit(", "), "p_type").alias("Categories"),
        F.concat("p_type", F.lit(", "), "p_brand").alias("Genres"),
    )
    play = F.col("playtime").cast("bigint")
    owners = F.concat((play * 10).cast("string"), F.lit(" - "), (play * 30).cast("string"))
    return games(spark, d).join(cats, "id").select(
        F.col("id").alias("AppID"),
        "Categories",
        "Genres",
        F.col("desenvolvedor_id").alias("Developers"),
        F.col("preco_base").alias("Price"),
        F.col("playtime").alias("Average playtime forever"),
        F.col("achievements").alias("Achievements"),
        F.col("pos").alias("Positive"),
        F.col("neg").alias("Negative"),
        F.col("avaliacao_media").alias("User score"),
        F.col("metacritic_score").alias("Metacritic score"),
        F.when(play > 0, owners).alias("Estimated owners"),
        F.col("data_lancamento").alias("Release date"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"),
    )


def session_events(events: DataFrame) -> DataFrame:
    """Event rows (batch or stream) read as finished play sessions."""
    fim = F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value") * 60, 6).cast("decimal(18,6)"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("usuario_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("jogo_id"),
        F.col("ts").alias("inicio"),
        F.col("value").alias("minutos"),
        fim.alias("fim"),
    )


_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "games": ((), """
        SELECT p_partkey AS id, p_name AS titulo, (p_size - 1) * 2.0::DOUBLE AS preco_base,
               coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg,
               5.0::DOUBLE * coalesce(pos, 0) / (coalesce(pos, 0) + coalesce(neg, 0) + 1) AS avaliacao_media,
               coalesce(pos, 0) + coalesce(neg, 0) AS total_avaliacoes,
               p_size % 19 AS idade_requerida, p_size * 2 AS metacritic_score,
               desenvolvedor_id, data_lancamento, coalesce(ach, 0) AS achievements, playtime
        FROM part LEFT JOIN (
            SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS pos,
                   count(*) FILTER (WHERE l_returnflag = 'R') AS neg,
                   min(l_suppkey) AS desenvolvedor_id, min(l_shipdate) AS data_lancamento,
                   count(*) FILTER (WHERE l_discount >= 0.10::DOUBLE) AS ach,
                   sum(l_quantity) AS playtime
            FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"""),
    "game_categories": ((), """
        SELECT p_partkey AS jogo_id, p_brand AS nome FROM part
        UNION ALL SELECT p_partkey, p_type FROM part"""),
    "achievements": ((), "SELECT l_partkey AS jogo_id FROM lineitem WHERE l_discount >= 0.10::DOUBLE"),
    "developers": ((), """
        SELECT s_suppkey AS id, s_name AS nome, n_name AS pais
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""),
    "users": ((), """
        SELECT c_custkey AS id, n_name AS pais, c_mktsegment AS tipo_assinatura
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "sessions": ((), """
        SELECT o_custkey AS usuario_id, l_partkey AS jogo_id,
               o_orderdate + to_hours((3 * l_linenumber)::BIGINT) AS inicio,
               o_orderdate + to_hours((3 * l_linenumber)::BIGINT) + to_hours(l_quantity::BIGINT) AS fim,
               CASE WHEN l_linenumber <> 7 THEN l_quantity END AS horas_jogadas
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "library": ((), """
        SELECT o_custkey AS usuario_id, l_partkey AS jogo_id, max(l_extendedprice) AS preco_pago
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""),
    "recs": ((), f"""
        SELECT c_custkey AS usuario_id, rank, item, score
        FROM customer JOIN (
            SELECT c_mktsegment AS seg, l_suppkey AS item, row_number() OVER w AS rank,
                   n / (max(n) OVER (PARTITION BY c_mktsegment))::DOUBLE AS score
            FROM (SELECT c_mktsegment, l_suppkey, count(*) AS n
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                  JOIN customer ON o_custkey = c_custkey
                  WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1, 2)
            WINDOW w AS (PARTITION BY c_mktsegment ORDER BY n DESC, l_suppkey)
            QUALIFY row_number() OVER w <= 20) ON seg = c_mktsegment"""),
    "truth": ((), f"""
        SELECT DISTINCT o_custkey AS usuario_id, l_suppkey AS item
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderdate >= TIMESTAMP '{CUT}'"""),
    "popularity": ((), "SELECT l_suppkey AS item, count(*) AS popularidade FROM lineitem GROUP BY 1"),
    "profiles": ((), "SELECT c_custkey AS usuario_id, c_mktsegment AS perfil FROM customer"),
    "supplier_catalog": ((), "SELECT s_suppkey AS item FROM supplier"),
    "emb_users": ((), """
        SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * 3.0::DOUBLE) AS vetor
        FROM embeddings WHERE vec_id % 5 = 0"""),
    "emb_items": ((), "SELECT vec_id AS id, embedding::DOUBLE[] AS vetor FROM embeddings WHERE vec_id % 5 <> 0"),
    "emb_requests": ((), "SELECT vec_id AS usuario_id FROM embeddings"),
    "catalog": ((), """
        SELECT doc_id AS "AppID", source || ' ' || (doc_id % 50)::VARCHAR AS "Name", text AS "About the game",
               CASE WHEN doc_id % 10 <> 0 THEN lang END AS "Genres",
               CASE WHEN doc_id % 7 <> 0 THEN source END AS "Tags",
               CASE WHEN doc_id % 9 <> 0 THEN lang || ',' || source END AS "Categories",
               source AS "Developers", CASE WHEN doc_id % 4 <> 0 THEN source END AS "Publishers",
               NULL::VARCHAR AS "Notes", (n_chars % 6000) / 100.0::DOUBLE - 1 AS "Price",
               (n_chars % 101)::DOUBLE AS "Metacritic score",
               lang AS real_genres, source AS real_tags, lang || ',' || source AS real_categories
        FROM documents"""),
    "raw_games": (("games",), """
        SELECT id AS "AppID", p_brand || ', ' || p_type AS "Categories", p_type || ', ' || p_brand AS "Genres",
               desenvolvedor_id AS "Developers", preco_base AS "Price", playtime AS "Average playtime forever",
               achievements AS "Achievements", pos AS "Positive", neg AS "Negative",
               avaliacao_media AS "User score", metacritic_score AS "Metacritic score",
               20.0::DOUBLE * CASE WHEN playtime > 0 THEN playtime END AS owners_number, data_lancamento AS "Release date"
        FROM games JOIN part ON p_partkey = id"""),
    "scored": ((), """
        SELECT doc_id, quality AS y, (n_chars % 1000) / 1000.0::DOUBLE AS score
        FROM labels JOIN documents USING (doc_id)"""),
    "session_stream": ((), """
        SELECT event_id AS id, user_id AS usuario_id, (props->>'k')::BIGINT AS jogo_id, ts AS inicio,
               value AS minutos, ts + to_microseconds(round(value * 60 * 1000000)::BIGINT) AS fim
        FROM events"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the named views (and what they need) as a WITH clause."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = _SQL[name]
        for other in needs:
            add(other)
        done[name] = text

    for name in names:
        add(name)
    views = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
