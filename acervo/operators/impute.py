"""Cleaning and layered imputation of an incomplete catalogue.

Every filled value carries a confidence label. Columns keep the raw
catalogue's names; ``AppID`` identifies a row and orders "first" choices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import (
    CountVectorizer,
    ElementwiseProduct,
    IDF,
    IndexToString,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from acervo.fixed_values import (
    FALLBACK_DEFAULTS,
    GENRE_KEYWORDS,
    GENRE_TO_TAGS,
    NUMERIC_COLUMNS,
    TAG_TO_CATEGORY,
    TEXT_COLUMNS,
)
from acervo.functions.lookup import skew_lookup
from acervo.functions.sampling import DRAWS, draw
from acervo.functions.scalars import (
    base_name,
    count_of,
    first_item,
    has_pattern,
    joined_labels,
    null_tokens,
    number_or_zero,
    parsed_date,
    positive_share,
    published_by,
)
from acervo.session import cut_lineage
from acervo.operators.pruned import CELL_ROWS, best_first, build_boxes
from acervo.operators.tiles import numbers, strips, top_per_row

KEY = "AppID"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def clean_catalog(df: DataFrame) -> DataFrame:
    """Numbers lenient with null as 0, texts as strings, no negative price, no date before 1970."""
    new = {c: number_or_zero(_c(c)) for c in NUMERIC_COLUMNS if c in df.columns}
    new |= {c: _c(c).cast("string") for c in TEXT_COLUMNS if c in df.columns}
    if "Price" in new:
        new["Price"] = F.greatest(new["Price"], F.lit(0.0))
    if "Release date" in df.columns:
        when = _c("Release date")
        if dict(df.dtypes)["Release date"] == "string":
            when = parsed_date(when)
        new["Release date"] = F.when(F.year(when) >= 1970, when)
    return df.withColumns(new)


def preprocess(df: DataFrame) -> DataFrame:
    """Plain variant: unknown texts, year and month, review totals, numeric nulls as 0."""
    out = df.drop("Movies").na.fill(
        "Unknown", [c for c in ("Genres", "Tags", "Categories", "Developers", "Publishers") if c in df.columns]
    )
    if "Release date" in out.columns:
        if dict(out.dtypes)["Release date"] == "string":
            out = out.withColumn("Release date", parsed_date(_c("Release date")))
        out = out.withColumn("Release Year", F.coalesce(F.year(_c("Release date")), F.lit(0)))
        out = out.withColumn("Release Month", F.coalesce(F.month(_c("Release date")), F.lit(0)))
    if {"Positive", "Negative"} <= set(out.columns):
        pos, neg = F.col("Positive"), F.col("Negative")
        out = out.withColumn("Total Reviews", pos + neg).withColumn("Positive Ratio", positive_share(pos, neg))
    return out.na.fill(0)


def franchise_publishers(df: DataFrame) -> DataFrame:
    """First publisher (by AppID) of each franchise, with the franchise's row count."""
    named = df.select(base_name(F.col("Name")).alias("_base"), "Publishers", KEY).where("_base IS NOT NULL")
    order = F.when(F.col("Publishers").isNotNull(), F.col(KEY))
    return named.groupBy("_base").agg(
        F.min_by("Publishers", order).alias("_franchise"), F.count("*").alias("n")
    )


def impute_publishers(df: DataFrame) -> DataFrame:
    """Franchise, then developer, then the notes; with the source as confidence."""
    based = df.withColumn("_base", base_name(F.col("Name")))
    joined = skew_lookup(based, franchise_publishers(df), "_base", ["_franchise"], F.col(KEY))
    pub, fr, dev = F.col("Publishers"), F.col("_franchise"), F.col("Developers")
    notes = published_by(F.col("Notes"))
    conf = (
        F.when(pub.isNotNull(), "none")
        .when(fr.isNotNull(), "high_franchise")
        .when(dev.isNotNull(), "medium_dev_as_pub")
        .when(notes.isNotNull(), "medium_notes_regex")
        .otherwise("none")
    )
    return (
        joined.withColumn("Publishers_confidence", conf)
        .withColumn("Publishers", F.coalesce(pub, fr, dev, notes))
        .drop("_base", "_franchise")
    )


def spot_genres(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Genres whose keywords occur in the description, as ``Genres_b3``."""
    about = F.lower(F.coalesce(_c("About the game"), F.lit("")))
    found = joined_labels({g: about.rlike(p) for g, p in GENRE_KEYWORDS.items()})
    return df.withColumn("Genres_b3", F.when(F.col("Genres").isNull(), found) if only_missing else found)


def spot_categories(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Categories implied by substrings of genres and tags, as ``Categories_d1``."""
    empty = F.lit("")
    text = F.lower(F.concat(F.coalesce("Genres", empty), F.lit(" "), F.coalesce("Tags", empty)))
    found = joined_labels({cat: text.contains(key) for key, cat in TAG_TO_CATEGORY.items()})
    return df.withColumn(
        "Categories_d1", F.when(F.col("Categories").isNull(), found) if only_missing else found
    )


def map_tags(df: DataFrame) -> DataFrame:
    """Tags implied by the primary genre, as ``Tags_c3``."""
    table = F.create_map(*[F.lit(x) for kv in GENRE_TO_TAGS.items() for x in kv])
    return df.withColumn("Tags_c3", F.try_element_at(table, first_item(F.col("Genres"))))


def _tfidf(df: DataFrame, text: str, terms: int):
    """Fitted stages giving L2-normed counts times ln((1+n)/(1+df)) + 1.

    Returns the function that applies them, the weighted rows of ``df`` itself,
    and the kept counts behind those rows; release them after the last fit.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True)
    stages = [words, StopWordsRemover(inputCol="_words", outputCol="_kept"), CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=terms)]
    counted = Pipeline(stages=stages).fit(df)
    rows = counted.transform(df).drop(text, "_words", "_kept").persist()
    idf = IDF(inputCol="_tf", outputCol="_x").fit(rows).idf
    weight = ElementwiseProduct(
        scalingVec=Vectors.dense([v + 1.0 for v in idf]), inputCol="_tf", outputCol="_w"
    )
    norm = Normalizer(inputCol="_w", outputCol="_tfidf", p=2.0)

    def apply(other: DataFrame) -> DataFrame:
        return norm.transform(weight.transform(counted.transform(other)))

    return apply, norm.transform(weight.transform(rows)), rows


def nb_classify(train: DataFrame, test: DataFrame, text: str, label: str, terms: int = 1000) -> DataFrame:
    """Multinomial naive Bayes on TF-IDF; (AppID, predicted) for ``test``.

    ``terms`` is a setting of the classifier: its features are so many most frequent words.
    """
    apply, known, kept = _tfidf(train.select(KEY, text, label), text, terms)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
    model = NaiveBayes(featuresCol="_tfidf", labelCol="_y", smoothing=1.0, modelType="multinomial").fit(
        index.transform(known)
    )
    kept.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="previsto", labels=index.labels)
    return back.transform(model.transform(apply(test))).select(KEY, "previsto")


def description_text() -> Column:
    empty = F.lit("")
    return F.concat(F.coalesce(_c("About the game"), empty), F.lit(" "), F.coalesce("Tags", empty))


def numeric_points(df: DataFrame) -> DataFrame:
    """Min-max scaled (price, metacritic, category commas) of every row as x, y, z."""
    zero = F.lit(0.0)
    raw = df.withColumns({
        "x": F.coalesce("Price", zero),
        "y": F.coalesce(_c("Metacritic score"), zero),
        "z": F.coalesce(count_of(F.col("Categories")), F.lit(0)).cast("double"),
    })
    names = ("x", "y", "z")
    row = raw.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]).first()
    scaled = {}
    for c in names:
        low, high = row[f"min_{c}"], row[f"max_{c}"]
        span = (high - low) if low is not None and high > low else 1.0
        scaled[c] = (F.col(c) - F.lit(low or 0.0)) / F.lit(span)
    return raw.withColumns(scaled)


def knn_classify(train: DataFrame, test: DataFrame, label: str, k: int = 5, box_rows: int = CELL_ROWS) -> DataFrame:
    """Vote of the k nearest training rows; both sides hold x, y, z.

    Rows at the same point with the same label are one cell with a count, so
    heavy repetition costs nothing. Equal distances are taken in point, then
    label order; an equal vote goes to the first label. Cells lie in boxes of about ``box_rows``; a
    point visits the nearest ones first, and none farther away than its k-th neighbour so far.
    """
    cells = train.groupBy("x", "y", "z", F.col(label).alias("rotulo")).agg(F.count("*").alias("n"))
    boxes = build_boxes(cells.withColumn("vetor", F.array("x", "y", "z")), ("x", "y", "z"), box_rows)
    asked = cut_lineage(test.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")).distinct())

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by([(n, "ascending") for n in ("x", "y", "z", "rotulo")])
        qp = [numbers(q, n) for n in ("qx", "qy", "qz")]
        cp = [numbers(c, n) for n in ("x", "y", "z")]
        picks, dist = [], []
        for part in strips(q.num_rows, c.num_rows) if c.num_rows else ():
            d = sum((a[part][:, None] - b[None, :]) ** 2 for a, b in zip(qp, cp))
            d = np.round(d, 12)
            rows, at = top_per_row(-d, k)
            picks.append((rows + part.start, at))
            dist.append(d[rows, at])
        rows = np.concatenate([p[0] for p in picks]) if picks else np.empty(0, np.int64)
        at = np.concatenate([p[1] for p in picks]) if picks else np.empty(0, np.int64)
        near = c.take(pa.array(at, pa.int64()))
        return pa.table({
            "qx": pa.array(qp[0][rows], pa.float64()),
            "qy": pa.array(qp[1][rows], pa.float64()),
            "qz": pa.array(qp[2][rows], pa.float64()),
            "score": pa.array(-np.concatenate(dist) if dist else [], pa.float64()),
            **{n: near.column(n) for n in ("x", "y", "z", "rotulo", "n")},
        })

    # each cell holds at least one row, so the k nearest cells of a point hold its k nearest rows
    schema = "qx double, qy double, qz double, score double, x double, y double, z double, rotulo string, n bigint"
    order = [F.desc("score"), *[F.col(c) for c in ("x", "y", "z", "rotulo")]]
    near = best_first(asked.withColumn("vetor", F.array("qx", "qy", "qz")), ["qx", "qy", "qz"], boxes, kernel, schema, order, k)
    point = W.partitionBy("qx", "qy", "qz").orderBy("rank")
    taken = (
        near.withColumn("antes", F.sum("n").over(point.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
        .withColumn("votos", F.least(F.col("n"), F.lit(k) - F.col("antes")))
        .where("votos > 0")
    )
    votes = taken.groupBy("qx", "qy", "qz", "rotulo").agg(F.sum("votos").alias("v"))
    verdict = votes.groupBy(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z")).agg(
        F.min_by("rotulo", F.struct(-F.col("v"), F.col("rotulo"))).alias("previsto")
    )
    return test.select(KEY, "x", "y", "z").join(verdict, ["x", "y", "z"]).select(KEY, "previsto")


CHAMPIONS = 16  # heaviest known texts of a word that give a first score
SIM_SLACK = 1e-8  # similarities are compared to nine places


def cosine_nearest(unknown: DataFrame, known: DataFrame, text: str, payload: str) -> DataFrame:
    """``payload`` of the known row whose ``text`` is most similar; (AppID, previsto).

    All distinct known texts are searched, over all their words. Equal
    similarity, also of texts that share no word with any, goes to the known row with the smallest id.

    Postings are rows (word, known text, weight). The heaviest ones of each word
    give an asked text a similarity that its best match reaches at least. Its words are taken from the rarest
    on; once the words that are left cannot reach that similarity alone, no match needs them first. So
    only those first words meet their postings, of these only the ones heavy enough, and what remains is verified word by word.
    """
    blank = F.coalesce(F.col(text), F.lit(""))
    chosen = known.where(F.col(payload).isNotNull()).select(KEY, blank.alias("_text"), F.col(payload).alias("previsto"))
    asked = unknown.select(KEY, blank.alias("_text"))
    cells = cut_lineage(chosen.groupBy("_text").agg(F.min_by("previsto", KEY).alias("previsto"), F.min(KEY).alias("id"), F.count("*").alias("m")))
    words = F.filter(F.regexp_extract_all(F.lower("_text"), F.lit(r"((?U)\b\w\w+\b)")), lambda w: w != "")

    def weighted(texts: DataFrame, name: str) -> DataFrame:
        """Word counts of distinct texts times their words' weights, scaled to length 1: name, w, v."""
        counts = texts.select(name, F.explode(words).alias("w")).groupBy(name, "w").agg(F.count("*").alias("tf"))
        rows = counts.join(weights, "w").withColumn("v", F.col("tf") * F.col("f"))
        length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(name)))  # of the words of one text
        return rows.select(name, "w", (F.col("v") / length).alias("v"))

    # inverse document frequencies over the known rows, from their distinct texts
    freq = cells.select("m", F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.sum("m").alias("df"))
    total = cells.agg(F.sum("m").alias("n"))  # one row
    weights = freq.join(F.broadcast(total)).select("w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("f"))
    postings = cut_lineage(weighted(cells, "id"))
    texts = asked.groupBy("_text").agg(F.count("*").alias("n")).withColumn("t", F.md5("_text"))
    want = cut_lineage(_from_the_rarest(weighted(texts, "t"), postings))

    heaviest = postings.withColumn("o", F.row_number().over(W.partitionBy("w").orderBy(F.desc("v"), "id"))).where(F.col("o") <= CHAMPIONS)
    first = want.select("t", "w", F.col("v").alias("a")).join(heaviest, "w").groupBy("t", "id").agg(F.sum(F.col("a") * F.col("v")).alias("sim"))
    reached = first.groupBy("t").agg((F.max("sim") - SIM_SLACK).alias("reached"))  # shared words only add to it

    prefix = want.join(reached, "t").where(F.col("rest") >= F.col("reached"))
    could = F.col("a") * F.col("v") + F.col("after")
    pairs = prefix.select("t", "w", F.col("v").alias("a"), "after", "reached").join(postings, "w").where(could >= F.col("reached")).select("t", "id").distinct()
    by_word = want.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("quer"))  # the words of one text
    entries = postings.groupBy("id").agg(F.collect_list(F.struct("w", "v")).alias("tem"))
    product = F.aggregate("tem", F.lit(0.0), lambda s, e: s + e["v"] * F.coalesce(F.try_element_at("quer", e["w"]), F.lit(0.0)))
    verified = pairs.join(by_word, "t").join(entries, "id").select("t", "id", F.round(product, 9).alias("sim")).where("sim > 0")
    winner = verified.groupBy("t").agg(F.min_by("id", F.struct(-F.col("sim"), F.col("id"))).alias("id"))
    best = winner.join(cells.select("id", F.col("previsto").alias("near")), "id").select("t", "near")
    plain = cells.agg(F.min_by("previsto", "id").alias("plain"))  # one row
    dim = texts.join(best, "t", "left").join(F.broadcast(plain)).select("_text", F.coalesce("near", "plain").alias("previsto"), "n")
    return skew_lookup(asked, dim, "_text", ["previsto"], F.col(KEY)).select(KEY, "previsto")


def _from_the_rarest(vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """Vectors (t, w, v) with bounds of what a known text can gain from a word and the more frequent ones (``rest``) and from those alone (``after``).

    Known vectors have length 1, so the words' own length is a bound, and so is their product with each word's largest weight.
    """
    largest = postings.groupBy("w").agg(F.max("v").alias("most"), F.count("*").alias("df"))
    rows = vectors.join(largest, "w")
    onward = W.partitionBy("t").orderBy(F.desc("df"), F.desc("w")).rowsBetween(W.unboundedPreceding, W.currentRow)  # the words of one text
    rest = F.least(F.sqrt(F.sum(F.col("v") * F.col("v")).over(onward)), F.sum(F.col("v") * F.col("most")).over(onward))
    rows = rows.withColumn("rest", rest)
    back = W.partitionBy("t").orderBy(F.desc("df"), F.desc("w"))
    return rows.withColumn("after", F.coalesce(F.lag("rest").over(back), F.lit(0.0))).select("t", "w", "v", "rest", "after")


def validation_mark(target: str, share: float = 0.3, seed: int = 42) -> Column:
    """Whether a row is one of the known rows, a seeded share of all of them, that techniques are checked on."""
    drawn = draw(F.col(KEY), seed) < int(share * DRAWS)
    return F.col(target).isNotNull() & drawn


def technique_scores(rows: DataFrame, target: str, techniques: Sequence[str]) -> DataFrame:
    """One row: 0.7 accuracy + 0.3 coverage of every technique over ``rows``."""
    real = first_item(F.col(target))
    out = []
    for t in techniques:
        guess = null_tokens(first_item(F.col(t)))
        accuracy = F.avg(F.when(guess.isNotNull(), (guess == real).cast("double")))
        share = F.avg(guess.isNotNull().cast("double"))
        out.append((accuracy * 0.7 + share * 0.3).alias(t))
    return rows.agg(*out)


def ensemble_impute(
    df: DataFrame, target: str, techniques: Sequence[str], checked: Column, keep: int = 3
) -> DataFrame:
    """Fill missing ``target`` values by the best techniques, best first.

    ``checked`` marks the validation rows. The one-row score table decides the
    order of the cascade. A technique that no validation row can judge is not used.
    """
    conf = f"{target}_confidence"
    if conf not in df.columns:
        df = df.withColumn(conf, F.lit("none"))
    if not techniques:
        return df
    scores = technique_scores(df.where(checked), target, techniques).first().asDict()
    ranked = sorted((t for t in techniques if scores[t] is not None), key=lambda t: -scores[t])[:keep]
    if not ranked:
        return df
    missing = F.col(target).isNull()
    guess = F.coalesce(*[null_tokens(F.col(t)) for t in ranked])
    filled = missing & guess.isNotNull()
    return df.withColumn(conf, F.when(filled, "high_ensemble").otherwise(F.col(conf))).withColumn(
        target, F.coalesce(F.col(target), guess)
    )


def fallback_impute(df: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Developer's most frequent value, else a constant; known rows are 'high'."""
    defaults = FALLBACK_DEFAULTS if defaults is None else defaults
    targets = list(defaults)
    marks = {}
    for col in [*targets, "Publishers"]:
        conf = f"{col}_confidence"
        now = F.col(conf) if conf in df.columns else F.lit("none")
        marks[conf] = F.when(F.col(col).isNotNull() & (now == "none"), "high").otherwise(now)
    marked = df.withColumns(marks)
    # one pass for all target columns: (developer, column, value) counts, then the mode
    long = df.where(F.col("Developers").isNotNull()).select(
        "Developers", F.posexplode(F.array(*[F.col(t) for t in targets])).alias("i", "v")
    )
    counts = long.groupBy("Developers", "i", "v").agg(F.count("*").alias("c"))
    order = F.when(F.col("v").isNotNull(), F.struct(-F.col("c"), F.col("v")))
    dim = counts.groupBy("Developers").agg(
        F.sum(F.when(F.col("i") == 0, F.col("c"))).alias("n"),
        *[F.min_by("v", F.when(F.col("i") == i, order)).alias(f"_m{i}") for i in range(len(targets))],
    )
    modes = [f"_m{i}" for i in range(len(targets))]
    joined = skew_lookup(marked, dim, "Developers", modes, F.col(KEY))
    out = {}
    for i, col in enumerate(targets):
        default = F.lit(defaults[col])
        guess = F.coalesce(F.col(f"_m{i}"), default)
        label = F.when(guess != default, "medium_dev_mode").otherwise("low_default")
        conf = f"{col}_confidence"
        out[conf] = F.when(F.col(col).isNull(), label).otherwise(F.col(conf))
        out[col] = F.coalesce(F.col(col), guess)
    return joined.withColumns(out).drop(*modes)


def _attach(df: DataFrame, guesses: DataFrame, name: str) -> DataFrame:
    return df.join(guesses.withColumnRenamed("previsto", name), KEY, "left")


NARROW = [KEY, "Name", "Genres", "Tags", "Categories", "Publishers", "Developers", "Price", "Metacritic score"]


def impute_catalog(df: DataFrame, share: float = 0.3) -> DataFrame:
    """The whole cascade: clean, special techniques, checked ensemble, fallback.

    ``AppID`` must be unique. A technique that learns is trained on the known
    rows outside the validation share and applied to that share and to the
    missing rows. The cascade runs on the short columns; the long texts are
    only scanned, and joined back once at the end.
    """
    wide = clean_catalog(df)
    short = spot_genres(wide, only_missing=False).select(*NARROW, "Notes", "Genres_b3")
    base = cut_lineage(impute_publishers(short).drop("Notes"))  # read by every technique

    def sides(rows: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
        checked = validation_mark(target, share)
        return rows.where(F.col(target).isNotNull() & ~checked), rows.where(F.col(target).isNull() | checked)

    label = first_item(F.col("Genres"))
    learn, ask = sides(numeric_points(base).withColumn("_label", label), "Genres")
    techniques = ["Genres_b3"]
    if not learn.isEmpty():
        text = wide.select(KEY, "Genres", label.alias("_label"), description_text().alias("_desc"))
        guesses = nb_classify(*sides(text, "Genres"), "_desc", "_label")
        base = _attach(base, guesses, "Genres_b1")
        base = _attach(base, knn_classify(learn, ask, "_label"), "Genres_b2")
        techniques = ["Genres_b1", "Genres_b2", "Genres_b3"]
    base = ensemble_impute(cut_lineage(base), "Genres", techniques, validation_mark("Genres", share))

    base = map_tags(base)
    learn, ask = sides(base, "Tags")
    base = _attach(base, cosine_nearest(ask, learn, "Genres", "Tags"), "Tags_c1")
    base = ensemble_impute(cut_lineage(base), "Tags", ["Tags_c1", "Tags_c3"], validation_mark("Tags", share))

    base = spot_categories(base, only_missing=False)
    base = ensemble_impute(base, "Categories", ["Categories_d1"], validation_mark("Categories", share))
    used = ["Genres_b1", "Genres_b2", "Genres_b3", "Tags_c1", "Tags_c3", "Categories_d1"]
    done = fallback_impute(base).drop(*used)
    rest = [c for c in wide.columns if c not in NARROW]
    return done.join(wide.select(KEY, *[_c(c) for c in rest]), KEY)


def confidence_report(df: DataFrame, columns: Sequence[str] = ("Publishers", "Genres", "Tags", "Categories")) -> DataFrame:
    """Rows per imputed column and confidence label."""
    long = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(f"{c}_confidence").alias("confianca")) for c in columns])
    return df.select(F.inline(long)).groupBy("coluna", "confianca").agg(F.count("*").alias("n"))
