import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.functions.lookup import align_to, lookup, skew_lookup
from acervo.operators import impute as I, normalize as N, profile as P

SCHEMA = "AppID bigint, Name string, Genres string, Tags string, Categories string, Publishers string, Developers string, Notes string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_publisher_cascade(spark):
    rows = [
        (1, "Saga 1", None, None, None, None, "DevA", None),
        (3, "Saga 3", None, None, None, "Late", "DevA", None),
        (2, "Saga 2: Gold", None, None, None, "Early", "DevA", None),
        (4, "2048", None, None, None, "Digits", None, None),
        (5, "1984", None, None, None, None, None, "Published by Old Co, 1984"),
        (6, "Solo", None, None, None, None, "DevB", "Publisher: X"),
        (7, "Alone", None, None, None, None, None, None),
        (8, None, None, None, None, None, None, "publisher: y"),
    ]
    got = {r["AppID"]: (r["Publishers"], r["Publishers_confidence"]) for r in I.impute_publishers(frame(spark, rows)).collect()}
    assert got == {
        1: ("Early", "high_franchise"), 2: ("Early", "none"), 3: ("Late", "none"), 4: ("Digits", "none"),
        5: ("Old Co", "medium_notes_regex"), 6: ("DevB", "medium_dev_as_pub"), 7: (None, "none"), 8: ("y", "medium_notes_regex"),
    }


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700)))
    dim = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.when(F.col("k") != "k5", F.upper("k")))
    out = skew_lookup(rows, dim, "k", ["v"], F.col("id"))
    assert out.columns == ["id", "k", "v"] and out.count() == 3000
    assert out.where("NOT (v <=> CASE WHEN k <> 'k5' THEN upper(k) END)").count() == 0
    small = spark.createDataFrame([("a", 1)], "k string, v int")
    asked = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted(r["v"] for r in lookup(asked, small, "k", "v", F.lit(9)).collect()) == [1, 9]
    assert sorted(tuple(r) for r in align_to(small, asked, "k").collect()) == [("a", 1), ("b", 0)]


def test_keyword_labels(spark):
    df = spark.createDataFrame([(1, None, "A TACTICAL Journey"), (2, "RPG", "war"), (3, None, None)], "AppID int, Genres string, `About the game` string")
    got = {r["AppID"]: r["Genres_b3"] for r in I.spot_genres(df).collect()}
    assert got == {1: "Adventure,Strategy", 2: None, 3: None}


def test_fallback_modes_and_ties(spark):
    rows = [
        (1, "a", "RPG", None, None, "p", "D", None), (2, "b", "Action", None, None, None, "D", None),
        (3, "c", None, "t", None, "p", "D", None), (4, "d", None, None, None, "p", None, None),
        (5, "e", "Indie", None, "c", "p", "E", None), (6, "f", None, None, None, "p", "E", None),
    ]
    got = {r["AppID"]: r for r in I.fallback_impute(frame(spark, rows)).collect()}
    assert got[3]["Genres"] == "Action" and got[3]["Genres_confidence"] == "medium_dev_mode"  # tie: first name
    assert got[4]["Genres"] == "Indie" and got[4]["Genres_confidence"] == "low_default"
    assert got[6]["Genres"] == "Indie" and got[6]["Genres_confidence"] == "low_default"  # mode equals the default
    assert got[1]["Genres_confidence"] == "high" and got[2]["Publishers_confidence"] == "none"
    assert all(r[c] is not None for r in got.values() for c in ("Genres", "Tags", "Categories"))


def test_ensemble_fills_from_few_known_rows(spark):
    df = spark.range(50).select(F.col("id").alias("AppID"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("Tags"), F.lit("y").alias("t"))
    out = I.ensemble_impute(df, "Tags", ["t"], F.col("Tags").isNotNull())
    assert out.where("Tags = 'y' AND Tags_confidence = 'high_ensemble'").count() == 25
    none = I.ensemble_impute(df, "Tags", ["t"], F.lit(False))
    assert none.where("Tags IS NULL").count() == 25


def test_ensemble_order_is_by_score(spark):
    df = spark.range(400).select(
        F.col("id").alias("AppID"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("Tags"),
        F.lit("bad").alias("t1"), F.when(F.col("id") % 4 > 1, F.lit("x")).alias("t2"), F.lit("<NA>").alias("t3"))
    out = I.ensemble_impute(df, "Tags", ["t1", "t2", "t3"], I.validation_mark("Tags"))
    assert {(r["m"], r["Tags"]): r["count"] for r in out.where("AppID % 2 = 1").groupBy((F.col("AppID") % 4).alias("m"), "Tags").count().collect()} == {(1, "bad"): 100, (3, "x"): 100}
    marked = df.where(I.validation_mark("Tags", 0.3)).count()
    assert 40 <= marked <= 80 and df.where(I.validation_mark("Tags", 1.0)).count() == 200


@pytest.mark.parametrize("box_rows", [3, 11, 20_000])
def test_knn_against_brute_force(spark, box_rows):
    rng = np.random.default_rng(9)
    pts = [(i, float(rng.integers(0, 6)), float(rng.integers(0, 4)), float(rng.integers(0, 2)), rng.choice(["A", "B", "C"]).item()) for i in range(300)]
    df = spark.createDataFrame(pts, "AppID bigint, x double, y double, z double, l string")
    train, test = df.where("AppID < 260"), df.where("AppID >= 260")
    got = {r["AppID"]: r["previsto"] for r in I.knn_classify(train, test, "l", box_rows=box_rows).collect()}
    for i, x, y, z, _ in pts[260:]:
        near = sorted(pts[:260], key=lambda p: (round((p[1] - x) ** 2 + (p[2] - y) ** 2 + (p[3] - z) ** 2, 12), p[1], p[2], p[3], p[4]))[:5]
        votes = Counter(p[4] for p in near)
        assert got[i] == min(votes, key=lambda c: (-votes[c], c))


def test_knn_visits_few_boxes(spark):
    from acervo.operators import pruned as P

    rng = np.random.default_rng(2)
    shares = []
    for n in (1000, 4000):
        pts = spark.createDataFrame([(i, *map(float, rng.random(3)), "A") for i in range(n)], "AppID bigint, x double, y double, z double, l string")
        boxes = P.build_boxes(pts.withColumn("vetor", F.array("x", "y", "z")), ("x", "y", "z"), 30)
        asked = pts.where("AppID % 10 = 0").select("AppID", F.array("x", "y", "z").alias("vetor"))

        def kernel(q, c):
            import pyarrow as pa

            from acervo.operators.tiles import matrix, top_per_row

            d = ((matrix(q, "vetor")[:, None] - matrix(c, "vetor")[None, :]) ** 2).sum(axis=2)
            rows, at = top_per_row(-d, 3)
            return pa.table({"AppID": q.column("AppID").take(pa.array(rows)), "score": -d[rows, at], "id": c.column("AppID").take(pa.array(at))})

        best = P.best_first(asked, ["AppID"], boxes, kernel, "AppID bigint, score double, id bigint", [F.desc("score"), F.col("id")], 3)
        assert {r["AppID"] for r in best.where("rank = 1 AND id = AppID").collect()} == set(range(0, n, 10))
        shares.append(P.share_scored(asked, boxes))
    assert shares[1] < 0.4 * shares[0] < 0.2  # four times the points, little more than the same work for each asker


def test_naive_bayes_against_direct_sums(spark):
    docs = [("orc sword magic", "RPG"), ("sword magic castle castle", "RPG"), ("tank gun war", "Action"), ("gun gun bomb war", "Action"), ("farm crop tank", "Sim")]
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(docs)], "AppID bigint, t string, l string")
    asks = ["magic sword bomb", "war farm gun", "crop crop"]
    test = spark.createDataFrame([(100 + i, t) for i, t in enumerate(asks)], "AppID bigint, t string")
    got = {r["AppID"]: r["previsto"] for r in I.nb_classify(train, test, "t", "l").collect()}
    vocab = sorted({w for t, _ in docs for w in t.split()})
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in t.split() for t, _ in docs))) + 1 for w in vocab}

    def vec(t):
        v = np.array([t.split().count(w) * idf[w] for w in vocab])
        return v / np.linalg.norm(v)

    labels = sorted({l for _, l in docs})
    for i, t in enumerate(asks):
        best = {}
        for l in labels:
            total = sum(vec(d) for d, m in docs if m == l) + 1.0
            n = sum(m == l for _, m in docs)
            best[l] = math.log((n + 1) / (len(docs) + len(labels))) + float(vec(t) @ np.log(total / total.sum()))
        assert got[100 + i] == max(best, key=best.get)


def test_cosine_takes_the_closest_and_the_first_on_a_tie(spark):
    known = spark.createDataFrame([(1, "action,rpg", "t1"), (2, "action", "t2"), (3, "action", "t3"), (4, None, "t4")], "AppID bigint, g string, p string")
    unknown = spark.createDataFrame([(10, "action"), (11, "rpg"), (12, None), (13, "puzzle")], "AppID bigint, g string")
    got = {r["AppID"]: r["previsto"] for r in I.cosine_nearest(unknown, known, "g", "p").collect()}
    assert got == {10: "t2", 11: "t1", 12: "t1", 13: "t1"}
    assert {r["previsto"] for r in I.cosine_nearest(unknown, known.where("AppID > 9"), "g", "p").collect()} == {None}


def test_cosine_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "CHAMPIONS", 2)
    rng = np.random.default_rng(6)
    names = [f"word{i}" for i in range(60)]
    share = np.array([1 / (i + 1) for i in range(60)])
    text = lambda: ",".join(rng.choice(names, rng.integers(1, 9), p=share / share.sum()))
    known = [(i, text(), f"p{i}") for i in range(400)]
    asked = [(1000 + i, text() + ("" if i % 5 else ",unseen")) for i in range(150)]
    kf = spark.createDataFrame(known, "AppID bigint, g string, p string")
    uf = spark.createDataFrame(asked, "AppID bigint, g string")
    got = {r["AppID"]: r["previsto"] for r in I.cosine_nearest(uf, kf, "g", "p").collect()}
    df = Counter(w for _, t, _ in known for w in set(t.split(",")))
    idf = {w: math.log((1 + len(known)) / (1 + n)) + 1 for w, n in df.items()}

    def vec(t):
        v = np.array([t.split(",").count(w) * idf.get(w, 0.0) for w in names])
        return v / (np.linalg.norm(v) or 1.0)

    table = np.stack([vec(t) for _, t, _ in known])
    for i, t in asked:
        sims = np.round(table @ vec(t), 9)
        assert got[i] == (f"p{int(np.argmax(sims))}" if sims.max() > 0 else "p0")


def test_whole_cascade_leaves_no_gap(spark, sf):
    from acervo.plans import bindings as B

    raw = B.catalog(spark, sf).drop("real_genres", "real_tags", "real_categories")
    out = I.impute_catalog(raw)
    assert out.count() == raw.count() == out.select("AppID").distinct().count()
    assert out.where("Genres IS NULL OR Tags IS NULL OR Categories IS NULL OR Publishers IS NULL").count() == 0
    kept = raw.alias("a").join(out.alias("b"), "AppID").where("a.Genres IS NOT NULL AND a.Genres <> b.Genres OR a.Tags IS NOT NULL AND a.Tags <> b.Tags")
    assert kept.count() == 0 and set(raw.columns) < set(out.columns)
    report = {(r["coluna"], r["confianca"]): r["n"] for r in I.confidence_report(out).collect()}
    assert sum(n for (c, _), n in report.items() if c == "Genres") == raw.count()


def test_normalized_tables(spark):
    import uuid

    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    rows = [
        (1, "Name A", "d", "x/apps/10/y", None, "UBI soft", None, "Action, rpg", "ACTION", None, "5", "3", "1", "0"),
        (2, "Name B", "d", None, "x/apps/10/z", "Ubi Soft", None, " ,Indie", None, "rpg", "7", "9", "0", "16"),
        (3, None, "d", "none", None, None, "pub co", "x", None, None, "-", "?", None, "3"),
        (4, None, "d", "x/apps/11/", None, None, None, None, None, None, "1", "1", "1", "3"),
    ]
    raw = spark.createDataFrame(rows, "o int, AppID string, Name string, `Header image` string, Screenshots string, Developers string, Publishers string, Categories string, Genres string, Tags string, Price string, Positive string, Negative string, `Required age` string")
    out = N.normalize_catalog(raw, F.col("o"))
    games = {r["id"]: r for r in out["jogos"].collect()}
    one = games[str(uuid.uuid5(ns, "10"))]
    assert len(games) == 2 and (one["titulo"], one["preco_base"]) == ("Name B", 7.0)  # later row
    assert (one["total_avaliacoes"], one["idade_requerida"]) == (4, 0)  # earlier row
    assert one["avaliacao_media"] == pytest.approx(4.5)
    assert games[str(uuid.uuid5(ns, "11"))]["titulo"] == "Unknown Game"
    assert {r["nome"] for r in out["desenvolvedores"].collect()} == {"Ubi Soft", "Unknown Developer"}
    assert {r["nome"] for r in out["categorias"].collect()} == {"Action", "Rpg", "Indie"}
    assert out["jogos_categorias"].count() == 3


def test_profile_reports(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "a", 1.0), (3, None, 2.0)], "k int, a string, b double")
    got = {r["coluna"]: round(r["pct_missing"], 3) for r in P.missing_report(df).collect()}
    assert got == {"a": 66.667, "b": 33.333}
    d = {r["coluna"]: (r["tipo"], r["nulos"], r["primeiro"]) for r in P.column_diagnostics(df, "k").collect()}
    assert d["a"] == ("string", 2, None) and d["k"] == ("int", 0, "1")
    assert P.cap_quantile(df.where("k > 9"), "b", 0.9).count() == 0
    assert P.drop_if_present(df, "zzz").columns == df.columns
