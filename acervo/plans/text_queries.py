"""Registered scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions import scalars as X
from acervo.functions.lookup import align_to, lookup
from acervo.plans import bindings as B
from acervo.plans.bindings import AS_OF, with_views
from acervo.plans.registry import register

KEYWORDS_SQL = """CASE WHEN regexp_matches(lower(text), 'action|shooter|combat|war|battle|explosion') THEN 'Action' END,
    CASE WHEN regexp_matches(lower(text), 'strategy|tactical|rts|turn-based') THEN 'Strategy' END,
    CASE WHEN contains(lower(text), 'en') THEN 'En' END"""


@register("text_names", "X-01 X-02 X-04 X-07 X-10 X-27", """
    SELECT doc_id, nullif(trim(regexp_replace(source || ' ' || (doc_id % 50), '\\s*\\d+.*$', '', 's')), '') AS base,
           nullif(trim(regexp_extract(CASE WHEN doc_id % 3 = 0 THEN 'PUBLISHER:  ' || source || ' Ltd. of ' || lang ELSE text END,
                  '(?:Published by|Publisher:)\\s*([^,.\\n]+)', 1, 'i')), '') AS publisher,
           string_split(lang || ',' || source, ',')[1] AS first_item,
           length(text) - length(replace(text, ',', '')) AS commas,
           upper(substr(trim(text, ' '), 1, 1)) || lower(substr(trim(text, ' '), 2)) AS cap,
           CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS token FROM documents""")
def _(s, d):
    t, i = F.col("text"), F.col("doc_id")
    note = F.when(i % 3 == 0, F.concat(F.lit("PUBLISHER:  "), "source", F.lit(" Ltd. of "), "lang")).otherwise(t)
    token = F.when(i % 3 == 0, F.lit("nan")).when(i % 3 == 1, F.lit("")).otherwise(F.col("lang"))
    return B.table(s, d, "documents").select(
        "doc_id",
        X.base_name(F.concat("source", F.lit(" "), (i % 50).cast("string"))).alias("base"),
        X.published_by(note).alias("publisher"),
        X.first_item(F.concat("lang", F.lit(","), "source")).alias("first_item"),
        X.count_of(t).alias("commas"),
        X.capitalized(t).alias("cap"),
        X.null_tokens(token).alias("token"),
    )


@register("text_labels", "X-06 X-08 X-11", f"""
    SELECT doc_id, nullif(concat_ws(',', {KEYWORDS_SQL}), '') AS labels,
           coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 5 = 0 THEN lang END, 'Unknown') AS filled
    FROM documents""")
def _(s, d):
    t, i = F.col("text"), F.col("doc_id")
    labels = X.joined_labels({
        "Action": X.has_pattern(t, "action|shooter|combat|war|battle|explosion"),
        "Strategy": X.has_pattern(t, "strategy|tactical|rts|turn-based"),
        "En": F.lower(t).contains("en"),
    })
    filled = F.coalesce(F.when(i % 2 == 0, F.col("source")), F.when(i % 5 == 0, F.col("lang")), F.lit("Unknown"))
    return B.table(s, d, "documents").select("doc_id", labels.alias("labels"), filled.alias("filled"))


@register("title_case", "X-09", """
    SELECT page_id, array_to_string(list_transform(range(1, length(url) + 1), lambda i:
        CASE WHEN i > 1 AND regexp_matches(substr(url, i - 1, 1), '[\\p{Lu}\\p{Ll}\\p{Lt}]')
             THEN lower(substr(url, i, 1)) ELSE upper(substr(url, i, 1)) END), '') AS titled FROM pages""")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", X.title_case(F.col("url")).alias("titled"))


@register("url_ids", "X-03", """
    SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id END, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 END) AS app_id FROM documents""")
def _(s, d):
    i = F.col("doc_id")
    first = F.when(i % 3 != 0, F.concat(F.lit("https://cdn/apps/"), i.cast("string"), F.lit("/header.jpg"))).otherwise("https://cdn/none")
    second = F.when(i % 2 == 0, F.concat(F.lit("https://cdn/apps/"), (i + 1).cast("string"), F.lit("/a.jpg,b.jpg")))
    return B.table(s, d, "documents").select("doc_id", X.id_from_url(first, second).alias("app_id"))


@register("date_parts", "X-12 X-13 X-14 X-24", f"""
    SELECT o_orderkey, o_orderdate AS parsed, year(o_orderdate)::INT AS y, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE month(o_orderdate) END::INT AS m,
           hour(o_orderdate + INTERVAL 7 HOUR)::INT AS h, greatest(1, date_diff('second', o_orderdate, TIMESTAMP '{AS_OF}') // 86400) AS days,
           o_orderdate - to_minutes(90) AS earlier FROM orders""")
def _(s, d):
    at, k = F.col("o_orderdate"), F.col("o_orderkey")
    shape = F.when(k % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(at, "MMM d, yyyy")).otherwise(F.date_format(at, "d MMM, yyyy"))
    return B.table(s, d, "orders").select(
        "o_orderkey",
        X.parsed_date(shape).alias("parsed"),
        X.part_or_zero("year", at).alias("y"),
        X.part_or_zero("month", F.when(k % 5 != 0, at)).alias("m"),
        X.part_or_zero("hour", at + F.make_dt_interval(hours=F.lit(7))).alias("h"),
        F.greatest(F.lit(1), X.whole_days(at, B.as_of())).alias("days"),
        X.minutes_before(at, F.lit(90.0)).alias("earlier"),
    )


@register("number_functions", "X-16 X-17 X-18 X-19 X-25", """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS lenient,
           round(ln(1 + p_size), 6) AS l1p, round(log10(p_retailprice), 6) AS l10, round(exp(p_size / 50.0::DOUBLE), 6) AS e,
           round(sqrt(p_size), 6) AS root, round(cos(2 * pi() * coalesce(CASE WHEN p_size <> 1 THEN p_size % 24 END, 12) / 24), 6) AS hc,
           round(sin(2 * pi() * coalesce(CASE WHEN p_size <> 1 THEN p_size % 24 END, 12) / 24), 6) AS hs,
           round((p_size - 1) / greatest(p_size - 1 + p_size % 2, 1)::DOUBLE, 6) AS share,
           round(p_size / (p_size + 3 + 1)::DOUBLE * 5, 6) AS five,
           round((p_retailprice / 7)::DECIMAL(38,10), 2)::DOUBLE AS cents FROM part""")
def _(s, d):
    k, z, p = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    dirty = F.when(k % 8 == 0, F.lit("n/a")).when(k % 4 == 0, F.lit("NaN")).otherwise(p.cast("string"))
    hc, hs = X.hour_cycle(F.when(z != 1, (z % 24).cast("double")))
    return B.table(s, d, "part").select(
        "p_partkey",
        X.number_or_zero(dirty).alias("lenient"),
        F.round(F.log1p(z), 6).alias("l1p"),
        F.round(F.log10(p), 6).alias("l10"),
        F.round(F.exp(z / F.lit(50.0)), 6).alias("e"),
        F.round(F.sqrt(z), 6).alias("root"),
        F.round(hc, 6).alias("hc"),
        F.round(hs, 6).alias("hs"),
        F.round(X.positive_share(z - 1, z % 2), 6).alias("share"),
        F.round(X.rating_of_five(z, F.lit(3)), 6).alias("five"),
        X.half_up(p / 7).alias("cents"),
    )


@register("array_functions", "X-05 X-21 X-22 X-23", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS n,
           CASE WHEN p_partkey % 5 = 0 THEN 'Unknown' ELSE p_brand END AS first_item,
           CASE WHEN p_partkey % 5 <> 0 AND p_type = 'PROMO' THEN 1 ELSE 0 END AS promo FROM part""")
def _(s, d):
    k = F.col("p_partkey")
    literal = F.when(k % 10 == 0, F.lit("not a list")).when(k % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']")))
    rows = B.table(s, d, "part").select("p_partkey", X.text_list(literal).alias("a"))
    return rows.select("p_partkey", F.size("a").alias("n"), X.first_or_unknown(F.col("a")).alias("first_item"),
                       X.has_item(F.col("a"), "PROMO").alias("promo"))


@register("name_uuids", "X-20", """
    WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_name || p_partkey)) AS h FROM part)
    SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
           substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def _(s, d):
    return B.table(s, d, "part").select("p_partkey", X.uuid5(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("id"))


@register("developer_lookup", "J-06", with_views("""
    SELECT g.id, coalesce(nome, 'Unknown') AS nome FROM games g
    LEFT JOIN (SELECT id * 2 AS did, nome FROM developers) ON did = desenvolvedor_id""", "games", "developers"))
def _(s, d):
    """All developers under twice their ids, so that games of odd ids find none."""
    dim = B.developers(s, d).select((F.col("id") * 2).alias("desenvolvedor_id"), "nome")
    return lookup(B.games(s, d).select("id", "desenvolvedor_id"), dim, "desenvolvedor_id", "nome", F.lit("Unknown")).select("id", "nome")


@register("aligned_users", "J-09", with_views("""
    SELECT u.id AS usuario_id, coalesce(h, 0) AS horas, coalesce(n, 0) AS n FROM users u LEFT JOIN (
      SELECT usuario_id * 2 AS usuario_id, sum(horas_jogadas) AS h, count(*) AS n FROM sessions GROUP BY 1) s
    ON s.usuario_id = u.id""", "users", "sessions"))
def _(s, d):
    """All sessions under twice their users' ids, so that odd users have none."""
    f = B.sessions(s, d).groupBy((F.col("usuario_id") * 2).alias("usuario_id")).agg(
        F.sum("horas_jogadas").alias("horas"), F.count("*").alias("n"))
    return align_to(f, B.users(s, d).withColumnRenamed("id", "usuario_id"), "usuario_id")
