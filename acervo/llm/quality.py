"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams are counted: one of a trusted target,
one of the whole raw corpus. A document's score is the sum of log(p_target /
p_raw) over its n-grams, divided by their number; a fixed threshold decides.

Only DataFrame functions run here; everything about a document is computed
within its row, so neither texts nor ids are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.15  # mean log ratio (natural logarithm) below which a text is rejected
TRUSTED_LIMIT = 50_000  # most trusted documents the target is fitted on
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "[^#*$%&|<>]+"
SPACE_RUN = r"[ \t-\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Runs of anything but the six ASCII spaces; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Only texts with a repeated hash are sorted.
    """

    def covered(starts: Column) -> Column:
        lengths = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    def equal_neighbour(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        return F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = F.sort_array(F.transform(let(ordered, equal_neighbour), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(starts, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def gram_buckets(words: Column) -> Column:
    """Bucket of every word and of every two neighbouring words."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    single = F.transform(words, lambda w: bucket(w))
    double = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(w, F.get(words, i + 1)))
    return F.concat(single, double)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", limit: int = TRUSTED_LIMIT) -> list[float]:
    """log(p_target / p_raw) of every bucket, both add-one smoothed.

    The raw multinomial counts all rows of docs. The target counts those whose
    key is among `trusted`: at most `limit` keys, the first by hash, so that the
    keys may be broadcast. BUCKETS counts come to the driver.
    """
    keys = trusted.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    keys = keys.orderBy(F.xxhash64("_key"), "_key").limit(limit).withColumn("_target", F.lit(1))
    rows = docs.select(F.col(key).alias("_key"), let(word_array(F.col(text)), gram_buckets).alias("_grams"))
    marked = rows.join(F.broadcast(keys), "_key", "left")
    grams = marked.select(F.coalesce("_target", F.lit(0)).alias("t"), F.explode("_grams").alias("g"))
    found = grams.groupBy("g").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in found:
        raw[r.g] += r.raw
        target[r.g] += r.target
    if all(n == 1 for n in target):
        return [0.0] * BUCKETS  # nothing is trusted: no verdict
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def rules(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """A struct of the base counts, base_failed, kept and llr of a text."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    body = F.coalesce(text.cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        total = let(gram_buckets(words), lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.greatest(F.size(g), F.lit(1)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(body, SYMBOLS, "")).cast("long").alias("n_symbols"),
            repeated_lines(body).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            total.alias("llr"),
        )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])
        kept = ~failed & (c["llr"] >= threshold)
        return F.struct(*(c[n].alias(n) for n in COUNTS), failed.alias("base_failed"), kept.alias("kept"), c["llr"].alias("llr"))

    return let(let(word_array(text), counts), verdict)


def quality_report(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged each, null keys are never trusted, other columns are left out,
    whatever their names. Without trusted rows every ratio is 0 and the base rules decide.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    ratios = log_ratios(rows, trusted.select(F.col(key).alias("_key")), "_text", "_key")
    found = rows.select(F.col("_key"), rules(F.col("_text"), ratios, threshold).alias("_rules"))
    return found.select(F.col("_key").alias(key), *(F.col(f"_rules.{n}").alias(n) for n in (*COUNTS, "base_failed", "kept", "llr")))


def keep_good(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    ratios = log_ratios(docs, trusted, text, key)
    return docs.where(rules(F.col(text), ratios, threshold)["kept"])
