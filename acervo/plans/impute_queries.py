"""Registered cleaning, imputation, normalisation and table-merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators import impute as I, normalize as N
from acervo.operators.profile import price_profile, temporal_split_counts
from acervo.plans import bindings as B
from acervo.plans.bindings import with_views
from acervo.plans.market_queries import r
from acervo.plans.registry import register
from acervo.sources import tables as T


@register("clean_catalog", "I-01 X-12 X-16", with_views("""
    SELECT "AppID", CASE WHEN "AppID" % 6 = 0 THEN 0 ELSE round(greatest("Price", 0), 6) END AS price,
           CASE WHEN "AppID" % 40 >= 10 THEN make_timestamp(1960 + "AppID" % 40, 3, 4, 0, 0, 0) END AS released FROM catalog""", "catalog"))
def _(s, d):
    i = F.col("AppID")
    raw = B.catalog(s, d).withColumn("Price", F.when(i % 6 == 0, F.lit("free")).otherwise(F.col("Price").cast("string"))).withColumn(
        "Release date", F.concat(F.lit("Mar 4, "), (F.lit(1960) + i % 40).cast("string")))
    out = I.clean_catalog(raw)
    return out.select("AppID", F.round("Price", 6).alias("price"), F.col("Release date").alias("released"))


def _publisher_input(s, d):
    i = F.col("AppID")
    return B.catalog(s, d).withColumns({
        "Name": F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(" only"))).otherwise(F.col("Name")),
        "Developers": F.when(i % 24 != 0, F.col("Developers")),
        "Notes": F.when(i % 48 == 0, F.concat(F.lit("Published by Nota "), (i % 5).cast("string"), F.lit(", long ago"))),
    })


@register("impute_publishers", "I-02 A-24 X-01 X-02", with_views("""
    WITH b AS (SELECT "AppID", "Publishers" AS pub, CASE WHEN "AppID" % 3 = 0 THEN NULL ELSE 'src' END AS base,
                 CASE WHEN "AppID" % 24 <> 0 THEN "Developers" END AS dev,
                 CASE WHEN "AppID" % 48 = 0 THEN 'Nota ' || ("AppID" % 5) END AS note FROM catalog),
    f AS (SELECT base, arg_min(pub, "AppID") FILTER (WHERE pub IS NOT NULL) AS fr FROM b WHERE base IS NOT NULL GROUP BY 1)
    SELECT "AppID", coalesce(pub, fr, dev, note) AS publisher,
           CASE WHEN pub IS NOT NULL THEN 'none' WHEN fr IS NOT NULL THEN 'high_franchise' WHEN dev IS NOT NULL THEN 'medium_dev_as_pub'
                WHEN note IS NOT NULL THEN 'medium_notes_regex' ELSE 'none' END AS conf
    FROM b LEFT JOIN f USING (base)""", "catalog"))
def _(s, d):
    out = I.impute_publishers(_publisher_input(s, d))
    return out.select("AppID", F.col("Publishers").alias("publisher"), F.col("Publishers_confidence").alias("conf"))


SPOT = """nullif(concat_ws(',', CASE WHEN regexp_matches(t, 'action|shooter|combat|war|battle|explosion') THEN 'Action' END,
    CASE WHEN regexp_matches(t, 'adventure|explore|journey|quest|narrative') THEN 'Adventure' END,
    CASE WHEN regexp_matches(t, 'rpg|role-playing|character|fantasy world') THEN 'RPG' END,
    CASE WHEN regexp_matches(t, 'simulation|simulator|realistic|management') THEN 'Simulation' END,
    CASE WHEN regexp_matches(t, 'strategy|tactical|rts|turn-based') THEN 'Strategy' END,
    CASE WHEN regexp_matches(t, 'horror|scary|spooky|survival horror') THEN 'Horror' END,
    CASE WHEN regexp_matches(t, 'indie|independent|small team') THEN 'Indie' END), '')"""


@register("spot_genres", "I-03 X-06 X-08", with_views(f"""
    SELECT "AppID", {SPOT} AS genres FROM (SELECT "AppID", lower("About the game") AS t FROM catalog)""", "catalog"))
def _(s, d):
    return I.spot_genres(B.catalog(s, d), only_missing=False).select("AppID", F.col("Genres_b3").alias("genres"))


@register("spot_genres_missing", "I-03", with_views(f"""
    SELECT "AppID", CASE WHEN g IS NULL THEN {SPOT} END AS genres
    FROM (SELECT "AppID", "Genres" AS g, lower("About the game") AS t FROM catalog)""", "catalog"))
def _(s, d):
    return I.spot_genres(B.catalog(s, d)).select("AppID", F.col("Genres_b3").alias("genres"))


def _genre_sides(s, d):
    rows = I.numeric_points(B.catalog(s, d)).withColumn("_label", F.col("Genres")).withColumn(
        "_desc", I.description_text())
    return rows.where("Genres IS NOT NULL"), rows.where("Genres IS NULL")


@register("naive_bayes_genres", "I-04")
def _(s, d):
    known, missing = _genre_sides(s, d)
    return I.nb_classify(known, missing, "_desc", "_label")


@register("naive_bayes_disjoint", "I-04", with_views("""
    SELECT "AppID", real_genres AS previsto FROM catalog WHERE "Genres" IS NULL""", "catalog"))
def _(s, d):
    """Texts whose words tell the genre: every genre's known texts have words of its own, and the missing rows get the genre of theirs."""
    own = F.concat_ws(" ", *[F.concat(F.lit(f"{w}xx"), F.col("real_genres")) for w in ("alpha", "beta", "gamma")])
    rows = B.catalog(s, d).withColumn("_desc", own).withColumn("_label", F.col("Genres"))
    return I.nb_classify(rows.where("Genres IS NOT NULL"), rows.where("Genres IS NULL"), "_desc", "_label")


@register("knn_genres", "I-05", with_views("""
    WITH raw AS (SELECT "AppID", "Genres" AS g, coalesce("Price", 0) AS x, coalesce("Metacritic score", 0) AS y,
                 coalesce(length("Categories") - length(replace("Categories", ',', '')), 0)::DOUBLE AS z FROM catalog),
    b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM raw),
    p AS (SELECT "AppID", g, (x - ax) / CASE WHEN bx > ax THEN bx - ax ELSE 1 END AS x, (y - ay) / CASE WHEN by_ > ay THEN by_ - ay ELSE 1 END AS y,
                 (z - az) / CASE WHEN bz > az THEN bz - az ELSE 1 END AS z FROM raw, b),
    nn AS (SELECT q."AppID", t.g FROM p q, p t WHERE q.g IS NULL AND t.g IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY q."AppID" ORDER BY round((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) + (q.z - t.z) * (q.z - t.z), 12), t.x, t.y, t.z, t.g) <= 5)
    SELECT "AppID", g AS previsto FROM (SELECT "AppID", g, count(*) AS v FROM nn GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY "AppID" ORDER BY v DESC, g) = 1""", "catalog"))
def _(s, d):
    known, missing = _genre_sides(s, d)
    return I.knn_classify(known, missing, "_label")


@register("cosine_tags", "I-06 J-11 O-04", with_views("""
    WITH k AS (SELECT "AppID", coalesce("Categories", '') AS t, "Tags" AS p FROM catalog WHERE "Tags" IS NOT NULL),
    kt AS (SELECT t, unnest(string_split(lower(t), ',')) AS w FROM k WHERE t <> ''),
    df AS (SELECT w, count(*) AS df FROM kt GROUP BY 1), n AS (SELECT count(*) AS n FROM k),
    idf AS (SELECT w, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS f FROM df, n),
    cells AS (SELECT t, arg_min(p, "AppID") AS p, min("AppID") AS id FROM k GROUP BY 1),
    cv AS (SELECT id, w, f / sqrt(sum(f * f) OVER (PARTITION BY id)) AS v FROM (
             SELECT id, unnest(string_split(lower(t), ',')) AS w FROM cells WHERE t <> '') JOIN idf USING (w)),
    u AS (SELECT "AppID", coalesce("Categories", '') AS t FROM catalog WHERE "Tags" IS NULL),
    uv AS (SELECT t, w, f / sqrt(sum(f * f) OVER (PARTITION BY t)) AS v FROM (
             SELECT DISTINCT t, unnest(string_split(lower(t), ',')) AS w FROM u WHERE t <> '') JOIN idf USING (w)),
    sim AS (SELECT uv.t, cv.id, round(sum(uv.v * cv.v), 9) AS s FROM uv JOIN cv USING (w) GROUP BY 1, 2),
    best AS (SELECT t, id FROM sim WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY s DESC, id) = 1)
    SELECT "AppID", p AS previsto FROM u LEFT JOIN best USING (t)
    JOIN cells ON cells.id = coalesce(best.id, (SELECT min(id) FROM cells))""", "catalog"))
def _(s, d):
    rows = B.catalog(s, d)
    return I.cosine_nearest(rows.where("Tags IS NULL"), rows.where("Tags IS NOT NULL"), "Categories", "Tags")


def _english(s, d):
    """Genre names of the tag table in the place of languages."""
    names = F.create_map(*[F.lit(x) for x in ("en", "Action,Indie", "fr", "RPG", "de", "Strategy,RPG", "es", "Puzzle")])
    return B.catalog(s, d).withColumn("Genres", F.try_element_at(names, F.col("Genres")))


@register("map_tags", "I-07 J-06", with_views("""
    SELECT "AppID", CASE "Genres" WHEN 'en' THEN 'Action,Shooter,Fast-Paced' WHEN 'fr' THEN 'RPG,Open World,Character Customization'
                    WHEN 'de' THEN 'Strategy,Tactical,RTS' END AS tags FROM catalog""", "catalog"))
def _(s, d):
    return I.map_tags(_english(s, d)).select("AppID", F.col("Tags_c3").alias("tags"))


@register("spot_categories", "I-08", with_views("""
    WITH t AS (SELECT "AppID", "Categories" AS c, CASE "AppID" % 4 WHEN 0 THEN 'Multiplayer,PvP' WHEN 1 THEN 'Singleplayer' WHEN 2 THEN 'Online Co-op' ELSE '' END AS g FROM catalog)
    SELECT "AppID", CASE WHEN c IS NULL THEN CASE "AppID" % 4 WHEN 0 THEN 'Multi-player,PvP' WHEN 1 THEN 'Single-player' WHEN 2 THEN 'Co-op,Online' END END AS cats FROM t""", "catalog"))
def _(s, d):
    i = F.col("AppID") % 4
    g = F.when(i == 0, "Multiplayer,PvP").when(i == 1, "Singleplayer").when(i == 2, "Online Co-op").otherwise("")
    return I.spot_categories(B.catalog(s, d).withColumn("Genres", g)).select("AppID", F.col("Categories_d1").alias("cats"))


ENSEMBLE = """
    WITH c AS (SELECT "AppID", "Tags" AS tg, "Publishers" AS t1, CASE WHEN "AppID" % 2 = 0 THEN "Developers" END AS t2,
                      "Genres" AS t3, 'nan' AS t4, split_part("Name", ' ', 1) AS t5 FROM catalog),
    v AS (SELECT * FROM c WHERE tg IS NOT NULL AND ('0x' || left(md5(CAST("AppID" AS VARCHAR) || ':42'), 15))::BIGINT < 345876451382054080),
    s AS (SELECT unnest(['t1', 't2', 't3', 't5']) AS t, unnest([
      0.7 * avg(CASE WHEN t1 IS NOT NULL THEN (t1 = tg)::INT END) + 0.3 * avg((t1 IS NOT NULL)::INT),
      0.7 * avg(CASE WHEN t2 IS NOT NULL THEN (t2 = tg)::INT END) + 0.3 * avg((t2 IS NOT NULL)::INT),
      0.7 * avg(CASE WHEN t3 IS NOT NULL THEN (t3 = tg)::INT END) + 0.3 * avg((t3 IS NOT NULL)::INT),
      0.7 * avg(CASE WHEN t5 IS NOT NULL THEN (t5 = tg)::INT END) + 0.3 * avg((t5 IS NOT NULL)::INT)]) AS sc FROM v),
    top AS (SELECT t, row_number() OVER (ORDER BY sc DESC, t) AS o FROM s QUALIFY o <= 3),
    g AS (SELECT "AppID", arg_min(val, o) AS guess FROM (
            SELECT "AppID", unnest(['t1', 't2', 't3', 't5']) AS t, unnest([t1, t2, t3, t5]) AS val FROM c) JOIN top USING (t)
          WHERE val IS NOT NULL GROUP BY 1)"""


@register("ensemble_impute", "I-09 P-18 O-04", with_views(ENSEMBLE + """
    SELECT "AppID", coalesce(tg, guess) AS tags, CASE WHEN tg IS NULL AND guess IS NOT NULL THEN 'high_ensemble' ELSE 'none' END AS conf
    FROM c LEFT JOIN g USING ("AppID")""", "catalog"))
def _(s, d):
    rows = B.catalog(s, d).withColumns({
        "t1": F.col("Publishers"), "t2": F.when(F.col("AppID") % 2 == 0, F.col("Developers")), "t3": F.col("Genres"),
        "t4": F.lit("nan"), "t5": F.split("Name", " ")[0]})
    out = I.ensemble_impute(rows, "Tags", ["t1", "t2", "t3", "t4", "t5"], I.validation_mark("Tags"))
    return out.select("AppID", F.col("Tags").alias("tags"), F.col("Tags_confidence").alias("conf"))


@register("ensemble_scores", "I-09", with_views(ENSEMBLE + """
    SELECT max(sc) FILTER (WHERE t = 't1') AS t1, max(sc) FILTER (WHERE t = 't2') AS t2, max(sc) FILTER (WHERE t = 't3') AS t3
    FROM (SELECT t, round(sc, 6) AS sc FROM s)""", "catalog"))
def _(s, d):
    rows = B.catalog(s, d).withColumns({
        "t1": F.col("Publishers"), "t2": F.when(F.col("AppID") % 2 == 0, F.col("Developers")), "t3": F.col("Genres")})
    checked = rows.where(I.validation_mark("Tags"))
    return I.technique_scores(checked, "Tags", ["t1", "t2", "t3"]).select(r("t1"), r("t2"), r("t3"))


def _mode_sql(col: str, name: str) -> str:
    return f"""{name} AS (SELECT "Developers" AS d, v AS m_{name} FROM (
        SELECT "Developers", "{col}" AS v, count(*) AS n FROM catalog WHERE "{col}" IS NOT NULL GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY "Developers" ORDER BY n DESC, v) = 1)"""


FALLBACK = f"""WITH {_mode_sql('Genres', 'ge')}, {_mode_sql('Tags', 'ta')}, {_mode_sql('Categories', 'ca')},
fb AS (SELECT "AppID", "Publishers" AS pub, "Genres" AS g, "Tags" AS t, "Categories" AS c,
    coalesce(m_ge, 'Indie') AS mg, coalesce(m_ta, 'singleplayer') AS mt, coalesce(m_ca, 'Single-player') AS mc
    FROM catalog LEFT JOIN ge ON ge.d = "Developers" LEFT JOIN ta ON ta.d = "Developers" LEFT JOIN ca ON ca.d = "Developers"),
fl AS (SELECT "AppID", coalesce(g, mg) AS genres, coalesce(t, mt) AS tags, coalesce(c, mc) AS cats,
    CASE WHEN g IS NOT NULL THEN 'high' WHEN mg <> 'Indie' THEN 'medium_dev_mode' ELSE 'low_default' END AS cg,
    CASE WHEN t IS NOT NULL THEN 'high' WHEN mt <> 'singleplayer' THEN 'medium_dev_mode' ELSE 'low_default' END AS ct,
    CASE WHEN c IS NOT NULL THEN 'high' WHEN mc <> 'Single-player' THEN 'medium_dev_mode' ELSE 'low_default' END AS cc,
    CASE WHEN pub IS NOT NULL THEN 'high' ELSE 'none' END AS cp FROM fb)
"""


@register("fallback_impute", "I-10 A-12", with_views(FALLBACK + "SELECT * FROM fl", "catalog"))
def _(s, d):
    out = I.fallback_impute(B.catalog(s, d))
    return out.select("AppID", F.col("Genres").alias("genres"), F.col("Tags").alias("tags"), F.col("Categories").alias("cats"),
                      F.col("Genres_confidence").alias("cg"), F.col("Tags_confidence").alias("ct"),
                      F.col("Categories_confidence").alias("cc"), F.col("Publishers_confidence").alias("cp"))


@register("confidence_report", "I-13", with_views(FALLBACK + """
    SELECT coluna, confianca, count(*) AS n FROM (
      SELECT 'Genres' AS coluna, cg AS confianca FROM fl UNION ALL SELECT 'Tags', ct FROM fl
      UNION ALL SELECT 'Categories', cc FROM fl UNION ALL SELECT 'Publishers', cp FROM fl) GROUP BY 1, 2""", "catalog"))
def _(s, d):
    return I.confidence_report(I.fallback_impute(B.catalog(s, d)))


@register("preprocess", "I-11 P-07 X-13 X-19", with_views("""
    SELECT "AppID", coalesce("Genres", 'Unknown') AS genres, coalesce("Tags", 'Unknown') AS tags, coalesce("Publishers", 'Unknown') AS pubs,
           CASE WHEN "AppID" % 11 = 0 THEN 0 ELSE 1990 + "AppID" % 30 END::INT AS y, CASE WHEN "AppID" % 11 = 0 THEN 0 ELSE 1 + "AppID" % 12 END::INT AS m,
           "AppID" % 7 + "AppID" % 3 AS total, round(("AppID" % 7) / greatest("AppID" % 7 + "AppID" % 3, 1)::DOUBLE, 6) AS share FROM catalog""", "catalog"))
def _(s, d):
    i = F.col("AppID")
    date = F.when(i % 11 != 0, F.make_date((F.lit(1990) + i % 30).cast("int"), (F.lit(1) + i % 12).cast("int"), F.lit(5)).cast("string")).otherwise("soon")
    raw = B.catalog(s, d).withColumns({"Release date": date, "Positive": i % 7, "Negative": i % 3, "Movies": F.lit("x")})
    out = I.preprocess(raw)
    return out.select("AppID", F.col("Genres").alias("genres"), F.col("Tags").alias("tags"), F.col("Publishers").alias("pubs"),
                      F.col("Release Year").alias("y"), F.col("Release Month").alias("m"),
                      F.col("Total Reviews").alias("total"), F.round("Positive Ratio", 6).alias("share"))


@register("imputed_catalog", "I-01 I-02 I-03 I-04 I-05 I-06 I-07 I-08 I-09 I-10")
def _(s, d):
    out = I.impute_catalog(B.catalog(s, d).drop("real_genres", "real_tags", "real_categories"))
    return out.select("AppID", "Publishers", "Genres", "Tags", "Categories", "Publishers_confidence", "Genres_confidence",
                      "Tags_confidence", "Categories_confidence")


def shifted(s, d):
    """Raw rows with the column shift: name in AppID, date in Name, id in the links."""
    i = F.col("AppID")
    link = F.concat(F.lit("https://cdn/apps/"), i.cast("string"), F.lit("/x.jpg"))
    return B.catalog(s, d).select(
        F.col("Name").alias("AppID"),
        F.lit("Mar 4, 2015").alias("Name"),
        F.when(i % 5 != 0, link).alias("Header image"),
        F.when(i % 10 == 5, link).alias("Screenshots"),
        F.when(i % 6 != 0, F.concat(F.upper("Developers"), F.lit("-games o'neil"))).alias("Developers"),
        "Publishers", "Categories", "Genres", "Tags",
        F.col("Price").cast("string").alias("Price"),
        (i % 13).cast("string").alias("Positive"),
        F.when(i % 4 != 0, (i % 5).cast("string")).otherwise("?").alias("Negative"),
        F.lit("7").alias("Required age"),
    )


SHIFTED = """sh AS (SELECT "AppID" AS id, "Name" AS titulo, "Price" AS preco, "AppID" % 13 AS pos, CASE WHEN "AppID" % 4 <> 0 THEN "AppID" % 5 ELSE 0 END AS neg,
    coalesce(CASE WHEN "AppID" % 6 <> 0 THEN replace("Developers", 'src', 'Src') || '-Games O''Neil' END, replace("Publishers", 'src', 'Src'), 'Unknown Developer') AS dev,
    "Categories" AS c, "Genres" AS g, "Tags" AS t FROM catalog WHERE "AppID" > 0 AND ("AppID" % 5 <> 0 OR "AppID" % 10 = 5)),
cats AS (SELECT DISTINCT id, upper(x[1]) || lower(substr(x, 2)) AS nome FROM (
    SELECT id, trim(unnest(string_split(concat_ws(',', c, g, t), ','))) AS x FROM sh) WHERE x <> '')"""


@register("normalized_games", "I-12 X-03 X-09 X-16 X-19 P-12", with_views(f"""WITH {SHIFTED}
    SELECT titulo, round(preco, 6) AS preco_base, round(pos / (pos + neg + 1)::DOUBLE * 5, 6) AS avaliacao_media,
           (pos + neg)::BIGINT AS total_avaliacoes, 7 AS idade_requerida, count(*) AS n FROM sh GROUP BY ALL""", "catalog"))
def _(s, d):
    games = N.normalize_catalog(shifted(s, d))["jogos"]
    return games.groupBy("titulo", r("preco_base"), r("avaliacao_media"), "total_avaliacoes", "idade_requerida").agg(F.count("*").alias("n"))


@register("developer_dim", "U-03 I-12 X-09", with_views(f"WITH {SHIFTED} SELECT DISTINCT dev AS nome, 'Unknown' AS pais FROM sh", "catalog"))
def _(s, d):
    return N.normalize_catalog(shifted(s, d))["desenvolvedores"].select("nome", "pais")


@register("category_dim", "U-01 I-12 X-10", with_views(f"WITH {SHIFTED} SELECT DISTINCT nome FROM cats", "catalog"))
def _(s, d):
    return N.normalize_catalog(shifted(s, d))["categorias"].select("nome")


@register("category_bridge", "U-02 I-12 X-20", with_views(f"WITH {SHIFTED} SELECT nome, count(*) AS jogos FROM cats GROUP BY 1", "catalog"))
def _(s, d):
    out = N.normalize_catalog(shifted(s, d))
    pairs = out["jogos_categorias"].join(out["categorias"].withColumnRenamed("id", "categoria_id"), "categoria_id")
    return pairs.join(out["jogos"].select(F.col("id").alias("jogo_id")), "jogo_id").groupBy("nome").agg(F.count("*").alias("jogos"))


@register("extract_games", "S-02 J-02", with_views("""
    SELECT g.id, titulo, preco_base, round(avaliacao_media, 6) AS avaliacao_media, total_avaliacoes, metacritic_score, idade_requerida,
           data_lancamento, d.nome AS dev_nome, d.id AS dev_id, categorias
    FROM games g LEFT JOIN developers d ON desenvolvedor_id = d.id
    LEFT JOIN (SELECT jogo_id, string_agg(nome, '|' ORDER BY nome) AS categorias FROM game_categories GROUP BY 1) ON jogo_id = g.id""",
    "games", "developers", "game_categories"))
def _(s, d):
    out = T.extract_ml_tables(B.games(s, d), B.developers(s, d), B.game_categories(s, d), B.users(s, d), B.sessions(s, d))[0]
    return out.withColumn("categorias", F.array_join("categorias", "|")).withColumn("avaliacao_media", r("avaliacao_media"))


@register("extract_users", "S-02", with_views("SELECT id, pais, tipo_assinatura FROM users", "users"))
def _(s, d):
    return T.extract_ml_tables(B.games(s, d), B.developers(s, d), B.game_categories(s, d), B.users(s, d), B.sessions(s, d))[1]


@register("extract_sessions", "S-02", with_views("SELECT usuario_id, jogo_id, horas_jogadas, inicio FROM sessions", "sessions"))
def _(s, d):
    return T.extract_ml_tables(B.games(s, d), B.developers(s, d), B.game_categories(s, d), B.users(s, d), B.sessions(s, d))[2]


@register("insert_ignore", "S-07", """
    SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'
    AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(s, d):
    cols = ["c_custkey", "c_name", "c_mktsegment"]
    new = B.table(s, d, "customer").select(*cols).where("c_mktsegment <> 'BUILDING'")
    have = B.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return T.insert_ignore(have, new.unionByName(new), ["c_custkey"])


@register("upsert_games", "S-08", with_views("""
    SELECT coalesce(n.id, g.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.titulo ELSE g.titulo END AS titulo,
           CASE WHEN n.id IS NOT NULL THEN n.preco_base ELSE g.preco_base END AS preco_base,
           CASE WHEN g.id IS NOT NULL THEN g.total_avaliacoes ELSE -1 END AS total_avaliacoes
    FROM games g FULL JOIN (SELECT id * 2 AS id, titulo || '!' AS titulo, preco_base + 1 AS preco_base FROM games) n ON n.id = g.id""", "games"))
def _(s, d):
    """All games, and a changed row of every game under twice its id: some of these ids are known, the others are new."""
    g = B.games(s, d).select("id", "titulo", "preco_base", "total_avaliacoes")
    new = g.select((F.col("id") * 2).alias("id"), F.concat("titulo", F.lit("!")).alias("titulo"),
                   (F.col("preco_base") + 1).alias("preco_base"), F.lit(-1).cast("bigint").alias("total_avaliacoes"))
    return T.upsert(g, new, ["id"], ["titulo", "preco_base"])


@register("finished_sessions", "S-11 X-24", with_views("""
    SELECT usuario_id, jogo_id, inicio, fim, 'PC' AS plataforma FROM session_stream WHERE minutos > 0""", "session_stream"))
def _(s, d):
    return T.finished_sessions(B.session_events(B.table(s, d, "events")).drop("inicio"))


@register("json_rows", "S-13", """
    SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def _(s, d):
    return T.to_json_rows(B.table(s, d, "nation"))


@register("valid_sessions", "P-13 J-04", with_views("""
    SELECT usuario_id, jogo_id, inicio FROM sessions WHERE usuario_id IN (SELECT id FROM users WHERE tipo_assinatura <> 'BUILDING')
    AND jogo_id IN (SELECT id FROM games WHERE preco_base > 20)""", "sessions", "users", "games"))
def _(s, d):
    from acervo.operators.features import valid_sessions

    out = valid_sessions(B.sessions(s, d), B.users(s, d).where("tipo_assinatura <> 'BUILDING'"), B.games(s, d).where("preco_base > 20"))
    return out.select("usuario_id", "jogo_id", "inicio")


@register("catalog_profile_json", "S-06", with_views("""
    SELECT (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (
        SELECT "Genres" AS v, count(*) AS n FROM catalog WHERE "Genres" IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 20)) AS genres,
        (SELECT count(*) FROM catalog) AS treino""", "catalog"))
def _(s, d):
    c = B.catalog(s, d).withColumn("Release date", F.lit("2015-01-01").cast("timestamp_ntz"))
    text = T.catalog_profile(c, temporal_split_counts(c, "Release date"), price_profile(c))
    kind = "temporal_split_sizes struct<treino:bigint>, top_genres array<struct<genero:string,n:bigint>>"
    j = F.from_json("value", kind)
    return text.select(F.array_join(F.transform(j["top_genres"], lambda g: F.concat_ws(":", g["genero"], g["n"])), ",").alias("genres"),
                       j["temporal_split_sizes"]["treino"].alias("treino"))
