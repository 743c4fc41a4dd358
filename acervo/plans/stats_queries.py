"""Registered profiles, exploratory reports and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.functions.scalars import owners_number
from acervo.operators import eda as E, profile as P, stats as T
from acervo.plans import bindings as B
from acervo.plans.bindings import with_views
from acervo.plans.market_queries import r
from acervo.plans.registry import register

PLAY = E.PLAYTIME
SPLIT = """(SELECT trim(unnest(string_split("{0}", ','))) AS g, "{1}" AS v FROM raw_games
            WHERE "{0}" IS NOT NULL AND "{1}" IS NOT NULL)"""
CAT_PRICE = SPLIT.format("Categories", "Price")
GENRE_PLAY = SPLIT.format("Genres", PLAY)
MIN = 80


@register("rows_without_nulls", "P-08", with_views("""
    SELECT "AppID", "Genres", "Tags" FROM catalog WHERE "Genres" IS NOT NULL AND "Tags" IS NOT NULL""", "catalog"))
def _(s, d):
    return P.dropna(B.catalog(s, d), ["Genres", "Tags"]).select("AppID", "Genres", "Tags")


@register("frequent_categories", "P-09", with_views(f"""
    SELECT jogo_id, nome FROM game_categories
    WHERE nome IN (SELECT nome FROM game_categories GROUP BY 1 HAVING count(*) > {MIN})""", "game_categories"))
def _(s, d):
    return P.keep_frequent(B.game_categories(s, d), "nome", MIN).select("jogo_id", "nome")


@register("price_cap_p95", "P-10", with_views("""
    SELECT id, preco_base FROM games WHERE preco_base <= (SELECT quantile_cont(preco_base, 0.95) FROM games)""", "games"))
def _(s, d):
    return P.cap_quantile(B.games(s, d).select("id", "preco_base"), "preco_base", 0.95)


@register("playtime_cap_p90", "P-10", with_views("""
    SELECT id, playtime FROM games WHERE playtime <= (SELECT quantile_cont(playtime, 0.90) FROM games)""", "games"))
def _(s, d):
    return P.cap_quantile(B.games(s, d).select("id", "playtime"), "playtime", 0.90)


@register("achievers", "P-11", with_views("""
    SELECT achievements, playtime FROM games WHERE achievements > 0 AND achievements <= 500 AND playtime > 0""", "games"))
def _(s, d):
    return E.achievers(B.raw_games(s, d)).select(
        F.col("Achievements").alias("achievements"), F.col(PLAY).alias("playtime"))


@register("quantity_percentile", "A-10", """
    SELECT round(quantile_cont(l_extendedprice, 0.83), 6) AS percentil FROM lineitem""")
def _(s, d):
    return P.percentile_linear(B.table(s, d, "lineitem"), "l_extendedprice", 0.83).select(r("percentil"))


@register("price_summary", "A-11 W-05", """
    SELECT round(avg(l_extendedprice), 4) AS media, round(stddev_pop(l_extendedprice), 4) AS desvio,
           (SELECT l_extendedprice FROM lineitem ORDER BY 1 OFFSET (SELECT count(*) // 2 FROM lineitem) LIMIT 1) AS mediana
    FROM lineitem""")
def _(s, d):
    out = P.summary_stats(B.table(s, d, "lineitem"), "l_extendedprice")
    return out.select(r("media", 4), r("desvio", 4), "mediana")


@register("category_mode_by_developer", "A-12", with_views("""
    SELECT desenvolvedor_id, nome AS moda FROM (
      SELECT desenvolvedor_id, nome, count(*) AS n FROM games JOIN game_categories ON id = jogo_id GROUP BY 1, 2)
    WHERE desenvolvedor_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY desenvolvedor_id ORDER BY n DESC, nome) = 1""", "games", "game_categories"))
def _(s, d):
    rows = B.game_categories(s, d).join(B.games(s, d).select(F.col("id").alias("jogo_id"), "desenvolvedor_id"), "jogo_id")
    return P.group_mode(rows, "desenvolvedor_id", "nome")


@register("top_category_pieces", "A-13 X-05", with_views(f"""
    SELECT g AS valor, count(*) AS n FROM {CAT_PRICE} GROUP BY 1 ORDER BY n DESC, valor LIMIT 20""", "raw_games"))
def _(s, d):
    return P.top_values(B.raw_games(s, d), "Categories", 20, split=True)


@register("top_genre_texts", "A-13", with_views("""
    SELECT "Genres" AS valor, count(*) AS n FROM catalog WHERE "Genres" IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, valor LIMIT 10""", "catalog"))
def _(s, d):
    return P.top_values(B.catalog(s, d), "Genres", 10)


@register("missing_report", "A-14", with_views("""
    SELECT coluna, round(pct, 6) AS pct_missing FROM (
      SELECT unnest(['Genres', 'Tags', 'Categories', 'Publishers', 'Notes', 'Price']) AS coluna,
             unnest([avg(("Genres" IS NULL)::INT) * 100, avg(("Tags" IS NULL)::INT) * 100,
                     avg(("Categories" IS NULL)::INT) * 100, avg(("Publishers" IS NULL)::INT) * 100,
                     avg(("Notes" IS NULL)::INT) * 100, avg(("Price" IS NULL)::INT) * 100]) AS pct FROM catalog)
    WHERE pct > 0""", "catalog"))
def _(s, d):
    return P.missing_report(B.catalog(s, d)).select("coluna", r("pct_missing"))


@register("column_diagnostics", "A-15", with_views("""
    SELECT 'Genres' AS coluna, 'string' AS tipo, count(*) FILTER (WHERE "Genres" IS NULL) AS nulos,
           (SELECT "Genres" FROM catalog ORDER BY "AppID" LIMIT 1) AS primeiro FROM catalog
    UNION ALL SELECT 'Tags', 'string', count(*) FILTER (WHERE "Tags" IS NULL),
           (SELECT "Tags" FROM catalog ORDER BY "AppID" LIMIT 1) FROM catalog
    UNION ALL SELECT 'Developers', 'string', count(*) FILTER (WHERE "Developers" IS NULL),
           (SELECT "Developers" FROM catalog ORDER BY "AppID" LIMIT 1) FROM catalog
    UNION ALL SELECT 'AppID', 'bigint', 0, (SELECT min("AppID")::VARCHAR FROM catalog)""", "catalog"))
def _(s, d):
    cols = B.catalog(s, d).select("AppID", "Genres", "Tags", "Developers")
    return P.column_diagnostics(cols, "AppID")


@register("temporal_split_counts", "A-16", """
    SELECT count(*) FILTER (WHERE year(o_orderdate) <= 1997) AS treino,
           count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1998 AND 1999) AS validacao,
           count(*) FILTER (WHERE year(o_orderdate) >= 2000) AS teste FROM orders""")
def _(s, d):
    return P.temporal_split_counts(B.table(s, d, "orders"), "o_orderdate", (1997, 1999))


@register("price_profile", "A-17", with_views("""
    SELECT round(avg("Price"), 6) AS mean, round(stddev_samp("Price"), 6) AS std,
           round(quantile_cont("Price", 0.5), 6) AS median FROM catalog""", "catalog"))
def _(s, d):
    return P.price_profile(B.catalog(s, d)).select(r("mean"), r("std"), r("median"))


@register("eda_price_by_category", "A-18 P-09 X-05", with_views(f"""
    SELECT g AS categoria, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
           round(quantile_cont(v, 0.5), 6) AS median FROM {CAT_PRICE} GROUP BY 1 HAVING count(*) > {MIN}""", "raw_games"))
def _(s, d):
    out = E.eda_price_by_category(B.raw_games(s, d), MIN)
    return out.select(F.col("Categories").alias("categoria"), F.col("count").alias("n"), r("mean"), r("std"), r("median"))


@register("eda_playtime_by_genre", "A-19", with_views(f"""
    SELECT g AS genero, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median
    FROM {GENRE_PLAY} WHERE v > 0 GROUP BY 1 HAVING count(*) > {MIN}""", "raw_games"))
def _(s, d):
    out = E.eda_playtime_by_genre(B.raw_games(s, d), MIN)
    return out.select(F.col("Genres").alias("genero"), F.col("count").alias("n"), r("mean"), r("median"))


DEV = """SELECT "Developers" AS dev, avg("User score") AS m, stddev_samp("User score") AS sd, count("User score") AS n
         FROM raw_games WHERE "Developers" IS NOT NULL GROUP BY 1 HAVING count("User score") >= 5"""


def _devs(df):
    return df.select(F.col("Developers").alias("dev"), F.round("mean", 6).alias("mean"),
                     F.round("std", 6).alias("std"), F.col("count").alias("n"))


@register("developer_best", "A-20 O-02", with_views(f"""
    SELECT dev, round(m, 6) AS mean, round(sd, 6) AS std, n FROM ({DEV})
    ORDER BY m DESC, sd, dev LIMIT 10""", "raw_games"))
def _(s, d):
    return _devs(E.developer_consistency(B.raw_games(s, d))[0])


@register("developer_worst", "A-20 O-02", with_views(f"""
    SELECT dev, round(m, 6) AS mean, round(sd, 6) AS std, n FROM ({DEV})
    ORDER BY m, sd, dev LIMIT 10""", "raw_games"))
def _(s, d):
    return _devs(E.developer_consistency(B.raw_games(s, d))[1])


@register("playtime_by_tier", "A-21 X-15", with_views("""
    SELECT CASE WHEN achievements <= 10 THEN 'Baixo (1-10)' WHEN achievements <= 50 THEN 'Médio (11-50)'
                WHEN achievements <= 150 THEN 'Alto (51-150)' ELSE 'Extremo (151-500)' END AS tier,
           round(avg(playtime), 6) AS mean, round(quantile_cont(playtime, 0.5), 6) AS median
    FROM games WHERE achievements > 0 AND achievements <= 500 AND playtime > 0 GROUP BY 1""", "games"))
def _(s, d):
    return E.playtime_by_tier(B.raw_games(s, d)).select("tier", r("mean"), r("median"))


SCORES = """(SELECT CASE WHEN pos + neg = 0 THEN 0 ELSE pos / (pos + neg)::DOUBLE END AS v,
             CASE WHEN preco_base <= -1 THEN NULL WHEN preco_base <= 0 THEN 'Gratuito' WHEN preco_base <= 5 THEN 'Baixo (<$5)'
                  WHEN preco_base <= 20 THEN 'Médio ($5-20)' WHEN preco_base <= 60 THEN 'Alto ($20-60)'
                  WHEN preco_base <= 500 THEN 'AAA ($60+)' END AS g FROM games)"""


@register("score_by_price_tier", "A-22 X-15 X-19", with_views(f"""
    SELECT g AS tier, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
           round(quantile_cont(v, 0.5), 6) AS median FROM {SCORES} WHERE g IS NOT NULL GROUP BY 1""", "games"))
def _(s, d):
    out = E.score_by_price_tier(B.raw_games(s, d))
    return out.select("tier", F.col("count").alias("n"), r("mean"), r("std"), r("median"))


def _anova_sql(rows: str, floor: int) -> str:
    return f"""
    WITH rws AS (SELECT g, v FROM {rows} WHERE g IS NOT NULL AND v IS NOT NULL),
    per AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS m2 FROM rws GROUP BY 1 HAVING count(*) > {floor}),
    tot AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS gm, sum(m2) AS w FROM per)
    SELECT round((SELECT sum(per.n * (m - gm) ** 2) FROM per, tot) / (k - 1) / (w / (n - k)), 6) AS f, k, n FROM tot WHERE k > 1"""


@register("anova_price_category", "T-01 P-09", with_views(_anova_sql(CAT_PRICE, MIN), "raw_games"))
def _(s, d):
    out = T.anova(E.category_prices(B.raw_games(s, d)), "Categories", "Price", MIN)
    return out.select(r("f"), "k", "n")


@register("anova_score_price_tier", "T-01 A-22", with_views(_anova_sql(SCORES, 0), "games"))
def _(s, d):
    return T.anova(E.price_scores(B.raw_games(s, d)), "tier", "score").select(r("f"), "k", "n")


@register("kruskal_playtime_genre", "T-02 W-05 P-09", with_views(f"""
    WITH rws AS (SELECT g, v FROM {GENRE_PLAY} WHERE v > 0
                 AND g IN (SELECT g FROM {GENRE_PLAY} WHERE v > 0 GROUP BY 1 HAVING count(*) > {MIN})),
    rk AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS rnk FROM rws),
    n AS (SELECT count(*)::DOUBLE AS n FROM rws),
    ties AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM rws GROUP BY v)),
    gs AS (SELECT g, count(*) AS ng, sum(rnk) AS s FROM rk GROUP BY 1)
    SELECT round((12 / (n * (n + 1)) * (SELECT sum(s * s / ng) FROM gs) - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 5) AS h,
           (SELECT count(*) FROM gs) AS k, n::BIGINT AS n FROM n, ties""", "raw_games"))
def _(s, d):
    return T.kruskal(E.genre_playtimes(B.raw_games(s, d)), "Genres", PLAY, MIN).select(r("h", 5), "k", "n")


@register("pearson_achievements_playtime", "T-03", with_views("""
    SELECT round(corr(achievements, playtime), 6) AS r, count(*) AS n FROM games
    WHERE achievements > 0 AND achievements <= 500 AND playtime > 0""", "games"))
def _(s, d):
    return T.pearson(E.achievers(B.raw_games(s, d)), "Achievements", PLAY).select(r("r"), "n")


@register("spearman_achievements_playtime", "T-04 W-05", with_views("""
    WITH rws AS (SELECT achievements AS x, playtime AS y FROM games
                 WHERE achievements > 0 AND achievements <= 500 AND playtime > 0),
    rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
                  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM rws)
    SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM rk""", "games"))
def _(s, d):
    return T.spearman(E.achievers(B.raw_games(s, d)), "Achievements", PLAY).select(r("rho"), "n")


@register("ks_quantity_price", "T-05 W-06", """
    WITH two AS (SELECT 'l_extendedprice' AS coluna, l_extendedprice AS v, l_returnflag AS f FROM lineitem
                 UNION ALL SELECT 'l_quantity', l_quantity, l_returnflag FROM lineitem),
    cells AS (SELECT coluna, v, count(*) FILTER (WHERE f = 'R') AS a, count(*) FILTER (WHERE f = 'A') AS b
              FROM two WHERE f IN ('R', 'A') GROUP BY 1, 2),
    run AS (SELECT coluna, sum(a) OVER w AS ca, sum(b) OVER w AS cb,
                   sum(a) OVER (PARTITION BY coluna) AS n1, sum(b) OVER (PARTITION BY coluna) AS n2
            FROM cells WINDOW w AS (PARTITION BY coluna ORDER BY v))
    SELECT coluna, round(max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)), 6) AS d,
           max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM run GROUP BY coluna""")
def _(s, d):
    lines = B.table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    out = T.ks_2samp(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"),
                     ["l_quantity", "l_extendedprice"])
    return out.select("coluna", r("d"), "n1", "n2")


@register("ks_quantity_price_test", "T-05", """
    WITH two AS (SELECT 'l_extendedprice' AS coluna, l_extendedprice AS v, l_returnflag AS f FROM lineitem
                 UNION ALL SELECT 'l_quantity', l_quantity, l_returnflag FROM lineitem),
    cells AS (SELECT coluna, v, count(*) FILTER (WHERE f = 'R') AS a, count(*) FILTER (WHERE f = 'A') AS b
              FROM two WHERE f IN ('R', 'A') GROUP BY 1, 2),
    run AS (SELECT coluna, sum(a) OVER w AS ca, sum(b) OVER w AS cb,
                   sum(a) OVER (PARTITION BY coluna) AS n1, sum(b) OVER (PARTITION BY coluna) AS n2
            FROM cells WINDOW w AS (PARTITION BY coluna ORDER BY v)),
    x AS (SELECT coluna, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) * sqrt(max(n1)::DOUBLE * max(n2) / (max(n1) + max(n2))) AS x FROM run GROUP BY 1),
    p AS (SELECT coluna, CASE WHEN any_value(x) < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * x * x)))) END AS p
          FROM x, range(1, 101) AS s(j) GROUP BY coluna)
    SELECT coluna, round(p, 6) AS p, p > 0.05 AS passou FROM p""")
def _(s, d):
    lines = B.table(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    out = T.ks_2samp(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["l_quantity", "l_extendedprice"], exact_up_to=0)
    return out.select("coluna", r("p"), "passou")


@register("ks_exact_balances", "T-05 W-06", """
    WITH RECURSIVE two AS (SELECT s_acctbal AS v, s_nationkey < 9 AS f FROM supplier),
    cells AS (SELECT v, count(*) FILTER (WHERE f) AS a, count(*) FILTER (WHERE NOT f) AS b FROM two GROUP BY v),
    run AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM cells WINDOW w AS (ORDER BY v)),
    one AS (SELECT max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(ca * n2 - cb * n1))::BIGINT AS h, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) AS d FROM run),
    path AS (
        SELECT 0::BIGINT AS k, n1, n2, h, list_transform(range(0, n1 + 1), lambda i: 0::DOUBLE) AS met FROM one
        UNION ALL
        SELECT k + 1, n1, n2, h, list_transform(range(0, n1 + 1), lambda i:
            CASE WHEN i > k + 1 OR k + 1 - i > n2 THEN 0::DOUBLE WHEN abs(i * n2 - (k + 1 - i) * n1) >= h THEN 1::DOUBLE
                 ELSE ((k + 1 - i) * met[i + 1] + CASE WHEN i > 0 THEN i * met[i] ELSE 0 END) / (k + 1)::DOUBLE END)
        FROM path WHERE k < n1 + n2
    )
    SELECT 's_acctbal' AS coluna, round(d, 6) AS d, one.n1, one.n2, round(met[one.n1 + 1], 6) AS p, round(met[one.n1 + 1], 6) > 0.05 AS passou
    FROM one JOIN path ON k = one.n1 + one.n2""")
def _(s, d):
    supplier = B.table(s, d, "supplier")
    out = T.ks_2samp(supplier.where("s_nationkey < 9"), supplier.where("NOT s_nationkey < 9"), ["s_acctbal"])
    return out.select("coluna", r("d"), "n1", "n2", r("p"), (r("p") > 0.05).alias("passou"))


@register("loglog_stderr", "T-06", with_views("""
    WITH p AS (SELECT log10(owners_number) AS x, log10("Positive" + "Negative") AS y FROM raw_games
               WHERE owners_number > 0 AND "Positive" + "Negative" > 0)
    SELECT count(*) AS n, round(sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (regr_sxx(y, x) * (count(*) - 2))), 6) AS stderr FROM p""", "raw_games"))
def _(s, d):
    rows = B.raw_games(s, d).select(owners_number(F.col("Estimated owners")).alias("owners"),
                                    (F.col("Positive") + F.col("Negative")).alias("reviews"))
    return T.loglog_fit(rows, "owners", "reviews").select("n", r("stderr"))


@register("loglog_owners_reviews", "T-06 X-17", with_views("""
    WITH p AS (SELECT log10(owners_number) AS x, log10("Positive" + "Negative") AS y FROM raw_games
               WHERE owners_number > 0 AND "Positive" + "Negative" > 0)
    SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
           round(corr(y, x), 6) AS r, round(regr_r2(y, x), 6) AS r2 FROM p""", "raw_games"))
def _(s, d):
    rows = B.raw_games(s, d).select(owners_number(F.col("Estimated owners")).alias("owners"),
                                    (F.col("Positive") + F.col("Negative")).alias("reviews"))
    return T.loglog_fit(rows, "owners", "reviews").select("n", r("slope"), r("intercept"), r("r"), r("r2"))


def _partial_sql(x: str, y: str, z: str) -> str:
    return f"""
    WITH c AS (SELECT count(*) AS n, corr({x}, {y}) AS xy, corr({x}, {z}) AS xz, corr({y}, {z}) AS yz FROM raw_games
               WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {z} IS NOT NULL)
    SELECT n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c"""


@register("partial_price_score_indie", "T-07 X-06",
          with_views(_partial_sql('"Price"', '"Achievements"', '(lower("Genres") LIKE \'%promo%\')::INT'), "raw_games"))
def _(s, d):
    rows = B.raw_games(s, d).withColumn("flag", F.col("Genres").ilike("%promo%").cast("double"))
    return T.partial_corr(rows, "Price", "Achievements", "flag").select("n", r("r"))


@register("partial_achievements_playtime_score", "T-07",
          with_views(_partial_sql('"Achievements"', f'"{PLAY}"', '"Metacritic score"'), "raw_games"))
def _(s, d):
    return T.partial_corr(B.raw_games(s, d), "Achievements", PLAY, "Metacritic score").select("n", r("r"))


@register("partial_achievements_playtime_interval", "T-07", with_views(
    "WITH pr AS (" + _partial_sql('"Achievements"', f'"{PLAY}"', '"Metacritic score"').replace(", 6) AS r", ", 15) AS r") + """)
    SELECT n, round(tanh(atanh(r) - 1.959963984540054 / sqrt(greatest(n - 4, 1))), 6) AS ci_low,
           round(tanh(atanh(r) + 1.959963984540054 / sqrt(greatest(n - 4, 1))), 6) AS ci_high FROM pr""", "raw_games"))
def _(s, d):
    return T.partial_corr(B.raw_games(s, d), "Achievements", PLAY, "Metacritic score").select("n", r("ci_low"), r("ci_high"))
