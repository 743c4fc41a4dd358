"""Exact Jaccard join of word n-gram sets, filtered under several global token orders.

A set of n grams that reaches the threshold with a partner shares at least
ceil(t n) grams with it, so under any global order of all grams the two sets
share one of their first n - ceil(t n) + 1. Three orders are used: grams by
their count in the corpus (rare first), and by a hash from its lower and from
its upper end. Pairs come from shared prefix grams of the first order, must
share prefix grams of the other two and be of fitting size, and only then are
whole sets compared. What the two ends lack of each other adds up: both lie apart.
In the first order places count too: if the first gram that two sets share stands at
places i and j, they have at most min(n - i, m - j) in common from there on, and the smaller
set has it among its first n - ceil(2t/(1+t) n) + 1. So frequent grams, last in their sets, seldom pair any.

Rows with equal sets are one class from the start. Only the classes' components
are wanted, so a gram that many classes share does not have to give all pairs:
its classes are compared with one of them, linked classes are contracted, and
only pairs still in different components remain for later rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import columns, covered, dropped, stored, text_batches, words

SLOTS = 1 << 18  # counters that estimate how often grams occur; grams share counters
SLICE = 1 << 11  # counters in one row
STAR_ROUNDS = 8  # most rounds that compare with one class each; then all pairs that are left
PAIRS_PER_POSTING = 1.0  # all pairs that are left are compared once they are no more than this for each posting there was
BROADCAST_IDS = 200_000  # ids up to this number are broadcast, more are joined by shuffling
ARROW_TEXTS = 2000  # rows of a batch of texts

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SALT = np.uint64(0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(found: list[bytes], size: int) -> np.ndarray:
    """Hash of every gram of `size` words; a shorter text is one gram as a whole, one without words has none."""
    if not found:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), ">u8").astype(np.uint64)
    length = min(size, len(h))
    out = np.full(len(h) - length + 1, length, np.uint64)
    for i in range(length):
        out = out * MULTIPLIER + h[i : len(h) - length + 1 + i]
    return mixed(out)


def gram_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct grams of a text, sorted."""
    grams = np.sort(gram_hashes(words(text), size))
    return grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _counts_and_sets(rows: DataFrame, size: int) -> DataFrame:
    """Per row: _key, n, print (128-bit digest of the set); per task: slices of the gram counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, kind = np.zeros(SLOTS, np.int64), None
        for batch, texts in text_batches(batches, "_text"):
            kind = batch.schema.field("_key").type
            sizes, prints = [], []
            for t in texts:
                grams = gram_set(t, size)
                counters += np.bincount((grams & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS) if len(grams) > SLOTS // 8 else 0
                if len(grams) <= SLOTS // 8:
                    np.add.at(counters, (grams & np.uint64(SLOTS - 1)).astype(np.int64), 1)
                sizes.append(len(grams))
                prints.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            n = len(texts)
            yield columns(batch, ["_key"], {
                "n": pa.array(sizes, pa.int32()), "print": pa.array(prints, pa.binary()),
                "slice": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.list_(pa.int64())),
            })
        if kind is not None:
            m = SLOTS // SLICE
            yield pa.RecordBatch.from_pydict({
                "_key": pa.nulls(m, kind), "n": pa.nulls(m, pa.int32()), "print": pa.nulls(m, pa.binary()), "slice": pa.array(range(m), pa.int32()),
                "counts": pa.ListArray.from_arrays(pa.array(range(0, SLOTS + 1, SLICE), pa.int32()), pa.array(counters)),
            })

    more = "n int, print binary, slice int, counts array<bigint>"
    return rows.mapInArrow(run, T.StructType([rows.schema["_key"], *T.StructType.fromDDL(more).fields]))


def _prefixes(rows: DataFrame, size: int, percent: int, counters: np.ndarray) -> DataFrame:
    """Per row with grams: _key, n, print, and the prefixes under the three orders."""
    shared = rows.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch, texts in text_batches(batches, "_text"):
            sizes, prints, lists, places = [], [], ([], [], []), []
            for row, t in enumerate(texts):
                grams = gram_set(t, size)
                n = len(grams)
                if not n:
                    continue
                p = prefix_length(n, percent)
                count = often[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
                lists[0].append(grams[np.lexsort((grams, count))[:p]].view(np.int64))
                other = np.sort((mixed(grams ^ SALT) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                lists[1].append(other[:p])
                lists[2].append(other[::-1][:p])
                places.append(row)
                sizes.append(n)
                prints.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in lists[0]], dtype=np.int64)]).astype(np.int32)
            flat = [pa.array(np.concatenate(x) if x else np.empty(0, kind)) for x, kind in zip(lists, (np.int64, np.int32, np.int32))]
            offsets = pa.array(lengths)
            yield columns(batch.select(["_key"]).take(pa.array(places, pa.int32())), ["_key"], {
                "n": pa.array(sizes, pa.int32()), "print": pa.array(prints, pa.binary()),
                **{name: pa.ListArray.from_arrays(offsets, x) for name, x in zip(("rare", "left", "right"), flat)},
            })

    more = "n int, print binary, rare array<bigint>, left array<int>, right array<int>"
    return rows.mapInArrow(run, T.StructType([rows.schema["_key"], *T.StructType.fromDDL(more).fields]))


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """Per row: print and grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "_text"):
            found = [gram_set(t, size) for t in texts]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "print": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary()),
                "grams": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).view(np.int64))),
            })

    return rows.mapInArrow(run, "print binary, grams array<bigint>")


def _candidates(postings: DataFrame, labels: DataFrame | None, left: float, most: float, percent: int, turn: int) -> tuple[DataFrame | None, float, DataFrame]:
    """Pairs (a, b) of classes to compare next, how many pairs will be left to list (0 where these are all), and postings that may yet give some.

    The postings given are those of the call before, and are removed once they are written anew.

    At most `most` pairs are listed at once, more only where comparing with one class no longer thins out what was `left`.
    """
    if labels is None:
        marked = postings.withColumn("label", F.col("class"))
    else:
        marked = postings.join(labels.withColumnRenamed("id", "class"), "class", "left").withColumn("label", F.coalesce("component", "class")).drop("component")
        marked = stored(marked)
        dropped(*postings.behind)
    # a pair has one side whose gram stands early enough to be the first that it shares with a set not smaller
    early = (F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n")
    by_label = marked.groupBy("gram", "label").agg(F.count("*").cast("double").alias("m"), F.count_if(early).cast("double").alias("e"))
    by_gram = by_label.groupBy("gram").agg((F.sum("m") * F.sum("e") - F.sum(F.col("m") * F.col("e"))).alias("pairs"))
    by_gram = stored(by_gram.where("pairs > 0"))
    total = by_gram.agg(F.sum("pairs").alias("pairs")).first()
    if not total.pairs:
        dropped(marked, by_gram)
        return None, 0.0, postings
    live = marked.join(by_gram.select("gram"), "gram", "left_semi")
    fits = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent) & (F.col("x.label") != F.col("y.label"))
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits &= rest * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    last = turn >= STAR_ROUNDS or total.pairs <= most or total.pairs > left / 2
    middle = None
    if last:
        smaller = F.struct("x.n", "x.class") < F.struct("y.n", "y.class")
        found = live.where(early).alias("x").join(live.alias("y"), "gram").where(fits & smaller)
    else:
        # first the set with the fewest grams rarer than this one, the one nearest to what the others have in common; later any
        order = F.col("pos") / F.col("n") if turn == 0 else F.lit(0.0)
        middle = live.groupBy("gram").agg(F.min(F.struct((~early).alias("late"), order.alias("o"), F.xxhash64("class", F.lit(turn)).alias("h"), "class", "n", "pos", "label")).alias("c"))
        middle = stored(middle)
        found = live.alias("x").join(middle.select("gram", "c.*").alias("y"), "gram").where(fits)
    pairs = stored(found.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct())
    dropped(middle)
    # a gram whose classes are all in one component stays so: later rounds leave its postings out
    again = live.drop("label")
    again.behind = (postings if labels is None else marked, by_gram)
    if last:
        dropped(*again.behind)
    return pairs, 0.0 if last else total.pairs, again


def _linked(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the written pairs that reach the threshold, written; the pairs are removed."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    ids = F.broadcast(ids) if 2 * pairs.count() <= BROADCAST_IDS else ids.distinct()
    info = classes.select("class", "n", "left", "right", "print", F.col("low").alias("key")).join(ids, "class", "left_semi")
    both = pairs.join(info.toDF("a", "na", "la", "ra", "pa", "ka"), "a").join(info.toDF("b", "nb", "lb", "rb", "pb", "kb"), "b")
    both = both.withColumn("low", F.array_intersect("la", "lb")).withColumn("high", F.array_intersect("ra", "rb"))
    both = both.withColumn("low_last", F.array_max("low")).withColumn("high_last", F.array_min("high"))

    # of the first grams at an end, up to the last one that both have, the others are in one set only; equal short hashes count as shared
    def apart(first: str, end: str) -> Column:
        return F.array_position(first, F.col(f"{end}_last")) - F.size(end) - (F.size(first) - F.size(F.array_distinct(first)))

    def enough(n: str, x: str, y: str) -> Column:
        lower, upper = apart(x, "low"), apart(y, "high")
        most = F.when(F.size(x) * 2 <= F.col(n), lower + upper).otherwise(F.greatest(lower, upper))  # the ends of a small set may overlap
        return (F.col(n) - most) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))

    meet = (F.size("low") > 0) & (F.size("high") > 0)
    good = stored(both.where(meet & enough("na", "la", "ra") & enough("nb", "lb", "rb")).select("a", "b", "na", "nb", "pa", "pb", "ka", "kb"))
    dropped(pairs)
    sides = (F.struct(F.col(x).alias("class"), F.col(f"p{x}").alias("print"), F.col(f"k{x}").alias("low")) for x in "ab")
    needed = stored(good.select(F.inline(F.array(*sides))).distinct())
    few = needed.count() <= BROADCAST_IDS
    keys, wanted = needed.select(F.col("low").alias("_k")).distinct(), needed.select("class", "print")
    texts = rows.join(F.broadcast(keys) if few else keys, F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    # dealt by class once: both joins below read the same shuffle
    sets = _sets(texts, size).join(F.broadcast(wanted) if few else wanted, "print").groupBy("class").agg(F.first("grams").alias("grams"))
    whole = good.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    common = whole.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("c"))
    found = stored(common.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent).select("a", "b"), ARROW_TEXTS)
    dropped(good, needed)
    return found


def _by_keys(docs: DataFrame, keys: DataFrame, key: str, how: str) -> tuple[DataFrame, DataFrame]:
    """A table of distinct keys as written, and docs joined (semi or anti, nulls equal) with it; it is broadcast only up to BROADCAST_IDS rows."""
    name = "_k"
    while name in docs.columns:
        name += "_"
    keys = stored(keys.toDF(name))
    return keys, docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, F.col(key).eqNullSafe(F.col(name)), how)


def _grouped(docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """Per row of docs: _key, n, print, root (of its component, null without grams), low (the component's smallest key)."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    first = stored(_counts_and_sets(rows, size), ARROW_TEXTS)
    slices = first.where("slice is not null").select("slice", F.posexplode("counts").alias("place", "c"))
    sums = slices.groupBy("slice", "place").agg(F.sum("c").alias("c")).toPandas()
    counters = np.zeros(SLOTS, np.int64)
    counters[(sums["slice"] * SLICE + sums["place"]).to_numpy(np.int64)] = sums["c"].to_numpy(np.int64)

    per_print = _prefixes(rows, size, percent, counters).groupBy("print").agg(
        F.min("_key").alias("low"), *(F.first(c).alias(c) for c in ("n", "rare", "left", "right")))
    classes = stored(per_print.withColumn("class", F.monotonically_increasing_id()), ARROW_TEXTS)
    grams = classes.select("class", "n", F.posexplode("rare").alias("pos", "gram"))
    # small sides of joins are written first: both sides are then plain shuffles, and a hot gram can be split
    shared = stored(grams.groupBy("gram").count().where("count > 1").select("gram"))
    postings = stored(grams.join(shared, "gram"))
    dropped(shared)
    most = PAIRS_PER_POSTING * postings.count()

    links, labels, turn, left = None, None, 0, float("inf")
    while left:
        pairs, left, postings = _candidates(postings, labels, left, most, percent, turn)
        if pairs is None:
            break
        found = _linked(pairs, classes, rows, size, percent)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionAll(found)
            last, labels = labels, components(links)
            dropped(last)
        turn += 1
    dropped(postings)

    own = first.where("slice is null").select("_key", "n", "print")
    named = classes.select("print", F.col("class").alias("root"), "low")
    if labels is not None:
        least = labels.join(classes.select(F.col("class").alias("id"), "low"), "id").groupBy("component").agg(F.min("low").alias("least"))
        joined = labels.join(least, "component").select(F.col("id").alias("root"), "component", "least")
        named = named.join(joined, "root", "left").select("print", F.coalesce("component", "root").alias("root"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("low"))
    return own.join(named, "print", "left")


def similar_sets(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the smallest key reachable by links).

    Two rows link when 100 * intersection >= percent * union of their sets of
    `size`-word grams (A-Z in lower case). A text with fewer words is one gram; null
    and empty texts have none and link with nothing: component_id is their own key. Repeated rows
    link like any equal texts. Null keys take part, but no component is named after them
    unless it has no other key. Other columns are left out, whatever their names.
    Grams are compared by 64-bit hashes, equal sets by 128-bit digests.
    """
    group = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("_key"))
    found = _grouped(docs, size, percent, text, key)
    return found.select(F.col("_key").alias(key), F.col("n").cast("long").alias("n_shingles"), group.alias("component_id"))


def _with_print(docs: DataFrame, size: int, text: str) -> DataFrame:
    """docs and _print, the digest of each row's set."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text):
            found = [hashlib.blake2b(gram_set(t, size).tobytes(), digest_size=16).digest() for t in texts]
            yield columns(batch, names, {"_print": pa.array(found, pa.binary())})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_print", T.BinaryType())]))


def keep_first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with one row of each component: that of the smallest key (null last); of several rows with that key any one.

    Rows without words (null and empty texts among them) all stay; of repeated rows one stays. Columns may have any
    names. An empty table gives an empty one.
    """
    own = docs.columns
    docs, named = covered(docs)
    return _first_of_each(docs, size, percent, named[text], named[key]).toDF(*own)


def _first_of_each(docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    names = docs.columns
    found = stored(_grouped(docs, size, percent, text, key))
    # A key that several rows have cannot tell them apart: such rows are told apart by their sets.
    shared = stored(found.groupBy("_key").count().where("count > 1 or _key is null").select("_key"))
    others = found.where("n > 0 and (low is not null and (_key is null or _key > low))").select("_key")
    _, kept = _by_keys(docs, others.unionAll(shared).distinct(), key, "left_anti")
    if shared.isEmpty():
        return kept
    twins = _with_print(_by_keys(docs, shared, key, "left_semi")[1], size, text)
    which = found.select(F.col("print").alias("_print"), "n", "root", "low").distinct()
    twins = twins.join(which.select("_print", F.col("n").alias("_n"), F.col("root").alias("_root"), F.col("low").alias("_low")), "_print")
    winners = twins.where(F.col(key).eqNullSafe(F.col("_low")) & (F.col("_n") > 0)).dropDuplicates(["_root"])
    return kept.unionByName(twins.where("_n = 0").select(names)).unionByName(winners.select(names))
