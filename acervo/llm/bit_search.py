"""Ranked lexical search by bit-sliced Bloom signatures.

The index keeps blocks of documents of similar length. Each document has a Bloom
signature of its terms, entered once for each power of two that the term's count
reaches; a block stores the signatures by slices, one bitmap over its documents
for each signature bit. The slices of a term, intersected, give the documents that
may hold it, never fewer than do. Its weight times the most that so many
occurrences can add, summed over an item's terms, is an upper bound of each document's score.

A search scores the documents of highest bounds exactly, which gives each item a
score that its last result reaches at least, then exactly rescores every document whose
bound does not stay below it. Results are those of scoring everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored, text_batches

BLOCK_DOCS = 512  # documents of a block, a power of two and 8 at least
BLOCK_BYTES = 8 << 20  # of slices, beyond which a block has fewer documents
BUFFER_DOCS, BUFFER_TERMS = 16 * BLOCK_DOCS, 1 << 21  # what a task sorts by length before it cuts blocks
BITS, HASHES = 10, 6  # signature bits for each entry of a block's longest document, slices of an entry
LEVELS = 24  # powers of two of a count that are entered
SEEDS = 16  # documents scored first for each item, k at least
ITEM_TERMS = 8_000  # distinct terms of the items that are searched at once
BROADCAST_IDS = 200_000  # up to so many documents to rescore are broadcast, more are joined by a shuffle

#: Bytes that belong to no term become spaces, A-Z becomes a-z; bytes of other characters stay.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GOLDEN, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(FOLD).split() if text else []


def slices_of(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Places of HASHES slices for each 64-bit term hash at a level, in a signature of `width` bits."""
    mixed = hashes + np.uint64(GOLDEN * (level + 1) & ALL)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    first, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(width)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """How many powers of two, from 1 on, a count reaches; LEVELS at most."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS)


def _block(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, bytes]:
    """Width and packed slices of documents given as (entries, term hashes, term levels)."""
    width = max(64, BITS * max(d[0] for d in docs))
    table = np.zeros((width, -(-len(docs) // 8)), np.uint8)
    for row, (_, hashes, levels) in enumerate(docs):
        for level in range(int(levels.max())):
            table[slices_of(hashes[levels > level], level, width).ravel(), row >> 3] |= np.uint8(128 >> (row & 7))
    return width, table.tobytes()


def _runs(entries: list[int]) -> Iterator[tuple[int, int]]:
    """Cuts ascending entry counts into blocks of BLOCK_DOCS, or fewer where their slices would exceed BLOCK_BYTES."""
    at = 0
    while at < len(entries):
        n = BLOCK_DOCS
        while n > 8 and BITS * entries[min(at + n, len(entries)) - 1] * n // 8 > BLOCK_BYTES:
            n //= 2
        yield at, at + n
        at += n


@dataclass(frozen=True)
class Index:
    """What a search reads: `blocks` of signatures, `counts` (term, df), and the totals of the collection."""

    docs: DataFrame  # (doc_id, text)
    blocks: DataFrame  # (ids, lengths, most, width, slices)
    counts: DataFrame  # (term, df)
    documents: int  # N: documents with a term
    length: int  # L: their terms with repeats


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """Signatures, document counts of terms and totals, from one reading of the texts; written to the shared folder.

    A document is a row: repeated rows are documents of their own. Null texts and
    texts without a term are no documents. Null keys are kept. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = rows.schema["doc_id"].dataType
    fields = [
        T.StructField("ids", T.ArrayType(ids)), T.StructField("lengths", T.BinaryType()), T.StructField("most", T.BinaryType()),
        T.StructField("width", T.IntegerType()), T.StructField("slices", T.BinaryType()),
        T.StructField("term", T.BinaryType()), T.StructField("df", T.LongType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        pending: list[tuple[int, object, int, int, np.ndarray, np.ndarray]] = []
        numbers: dict[bytes, int] = {}
        held = 0
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pending, numbers, held
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in numbers), np.uint64, len(numbers))
            df = np.zeros(len(numbers), np.int64)
            for doc in pending:
                df[doc[4]] += 1
            found = list(numbers)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield batch_of({"term": pa.array(part, pa.binary()), "df": pa.array(df[i : i + len(part)], pa.int64())}, len(part))
            pending.sort(key=lambda d: d[0])
            for start, stop in _runs([d[0] for d in pending]):
                part = pending[start:stop]
                width, slices = _block([(d[0], hashes[d[4]], d[5]) for d in part])
                yield batch_of({
                    "ids": pa.array([[d[1] for d in part]], pa.list_(kind)),
                    "lengths": pa.array([np.array([d[2] for d in part], "<i8").tobytes()], pa.binary()),
                    "most": pa.array([np.array([d[3] for d in part], "<i8").tobytes()], pa.binary()),
                    "width": pa.array([width], pa.int32()), "slices": pa.array([slices], pa.binary()),
                }, 1)
            pending, numbers, held = [], {}, 0

        def batch_of(given: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            types = {"ids": pa.list_(kind), "width": pa.int32(), "df": pa.int64()}
            names = [f.name for f in fields]
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, types.get(c, pa.binary()))) for c in names], names)

        for batch, texts in text_batches(batches, "text"):
            kind = batch.column(0).type
            for doc_id, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                counted = Counter(terms(t))
                if not counted:
                    continue
                places = np.fromiter((numbers.setdefault(w, len(numbers)) for w in counted), np.int64, len(counted))
                tf = np.fromiter(counted.values(), np.int64, len(counted))
                levels = levels_of(tf)
                pending.append((int(levels.sum()), doc_id, int(tf.sum()), int(tf.max()), places, levels))
                held += len(counted)
                if len(pending) >= BUFFER_DOCS or held >= BUFFER_TERMS:
                    yield from flush()
        if pending:
            yield from flush()

    table = stored(rows.mapInArrow(run, T.StructType(fields)))
    blocks = table.where("slices is not null").select("ids", "lengths", "most", "width", "slices")
    counts = table.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    total = blocks.select("lengths").mapInArrow(_sums, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return Index(rows, blocks, counts, total.n or 0, total.l or 0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [np.frombuffer(b, "<i8") for b in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": [len(x) for x in lengths], "l": [int(x.sum()) for x in lengths]})


@dataclass(frozen=True)
class Queries:
    """Items that are searched at once: terms with weights, and for each item the places of its terms."""

    items: list[object]
    terms: dict[bytes, int]
    weights: np.ndarray
    parts: list[np.ndarray]
    documents: int
    length: int

    def shift(self, lengths: np.ndarray) -> np.ndarray:
        """8 m of documents with so many terms."""
        return 8 * (10 + 90 * lengths * self.documents // self.length)


def query_groups(index: Index, items: DataFrame, text: str = "text", key: str = "item_id") -> Iterator[Queries]:
    """The items in groups of about ITEM_TERMS distinct terms; rows of one item id are one item. The items are the asker's list, read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            found = [sorted(set(terms(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    rows = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    held = rows.mapInArrow(run, T.StructType([rows.schema["item"], T.StructField("terms", T.ArrayType(T.BinaryType()))]))
    asked = held.select("item", F.explode("terms").alias("term")).distinct()
    weighed = asked.join(index.counts, "term").select(
        "item", "term", F.floor(F.lit(1000.0) * F.log((2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    group: dict[object, list[tuple[bytes, int]]] = {}
    last, known = object(), set()
    for r in weighed.where("w > 0").orderBy("item", "term").toLocalIterator():
        if r.item != last and len(known) >= ITEM_TERMS:
            yield _grouped(group, index)
            group, known = {}, set()
        last = r.item
        group.setdefault(r.item, []).append((bytes(r.term), r.w))
        known.add(bytes(r.term))
    if group:
        yield _grouped(group, index)


def _grouped(group: dict[object, list[tuple[bytes, int]]], index: Index) -> Queries:
    weights: dict[bytes, int] = {t: w for found in group.values() for t, w in found}
    places = {t: i for i, t in enumerate(weights)}
    parts = [np.array([places[t] for t, _ in found], np.int64) for found in group.values()]
    return Queries(list(group), places, np.array(list(weights.values()), np.int64), parts, index.documents, index.length)


def bounds(asked: Queries, hashes: np.ndarray, lengths: np.ndarray, most: np.ndarray, width: int, slices: bytes) -> np.ndarray:
    """Upper bounds of the score of each item (row) in each document of a block (column)."""
    table = np.frombuffer(slices, np.uint8).reshape(width, -1)
    shift = asked.shift(lengths)
    n = len(lengths)
    best = np.zeros((len(hashes), n), np.int64)
    left = np.arange(len(hashes))
    held = np.full((len(hashes), table.shape[1]), 255, np.uint8)
    for level in range(LEVELS):
        places = slices_of(hashes[left], level, width)
        for j in range(HASHES):
            held &= table[places[:, j]]
        stays = held.any(axis=1)
        left, held = left[stays], held[stays]
        if not len(left):
            break
        # so many occurrences at most, unless the next level is entered as well
        count = np.minimum((2 << level) - 1, most) if level + 1 < LEVELS else most
        worth = 1_000_000_000 * count // (1000 * count + shift)
        on = np.unpackbits(held, axis=1)[:, :n].astype(bool)
        best[left] = np.where(on, asked.weights[left, None] * worth[None, :], best[left])
    return np.stack([best[p].sum(axis=0) for p in asked.parts])


def _bounded(index: Index, asked: Queries, kind: T.DataType, top: int | None, floor: np.ndarray | None) -> DataFrame:
    """(item, doc_id, bound): a task's `top` highest bounds of each item, or all bounds that reach the item's floor."""
    shared = index.blocks.sparkSession.sparkContext.broadcast((asked, floor))
    schema = T.StructType([T.StructField("item", T.IntegerType()), index.docs.schema["doc_id"], T.StructField("bound", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        asked, floor = shared.value
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in asked.terms), np.uint64, len(asked.terms))
        best: list[list[tuple[int, object]]] = [[] for _ in asked.items]
        ids_type = None

        def out(item: list[int], doc: list[object], bound: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, ids_type), pa.array(bound, pa.int64())], ["item", "doc_id", "bound"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids_type = batch.schema.field("ids").type.value_type
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "lengths", "most", "width", "slices")}
                scores = bounds(asked, hashes, np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["most"], "<i8"), row["width"], row["slices"])
                if floor is not None:
                    item, doc = np.nonzero(scores >= floor[:, None])
                    if len(item):
                        yield out(item.tolist(), [row["ids"][d] for d in doc.tolist()], scores[item, doc].tolist())
                    continue
                kept = np.argsort(-scores, axis=1, kind="stable")[:, :top]
                for q, docs in enumerate(kept.tolist()):
                    least = best[q][-1][0] if len(best[q]) >= top else 0
                    new = [(int(scores[q, d]), row["ids"][d]) for d in docs if scores[q, d] > least]
                    if new:
                        best[q] = sorted(best[q] + new, key=lambda x: -x[0])[:top]
        if floor is None and any(best):
            flat = [(q, doc, bound) for q, found in enumerate(best) for bound, doc in found]
            yield out(*map(list, zip(*flat, strict=True)))

    return index.blocks.mapInArrow(run, schema)


def _scored(index: Index, asked: Queries, pairs: DataFrame) -> DataFrame:
    """(item, doc_id, score): exact scores of all rows whose id stands in the pairs (item, doc_id), those above 0."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(asked)
    wanted = stored(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")))
    small = wanted.count() <= BROADCAST_IDS
    wanted = wanted.withColumnRenamed("doc_id", "_wanted")
    rows = index.docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("_wanted"))).select("doc_id", "text", "items")
    schema = T.StructType([T.StructField("item", T.IntegerType()), index.docs.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        weights = asked.weights.tolist()
        parts = [p.tolist() for p in asked.parts]
        for batch, texts in text_batches(batches, "text"):
            items, docs, scores = [], [], []
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, t, asked_by in zip(ids, texts, wanted, strict=True):
                counted = Counter(terms(t))
                length = sum(counted.values())
                if not length:
                    continue
                shift = 8 * (10 + 90 * length * asked.documents // asked.length)
                worth = {}
                for w, tf in counted.items():
                    if (place := asked.terms.get(w)) is not None:
                        worth[place] = weights[place] * (1_000_000_000 * tf // (1000 * tf + shift))
                for item in asked_by:
                    score = sum(worth.get(place, 0) for place in parts[item])
                    if score > 0:
                        items.append(item)
                        docs.append(doc_id)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(docs, batch.column(0).type), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, schema)


def _ranked(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id (nulls first).

    Exact: a document is left out only if its upper bound stays below the k-th best
    exact score among the first ones scored. Rows with the same doc_id are documents each, ranked
    beside each other. Items with a null text, without terms or whose terms no document holds give no
    row; rows of one item id are one item. Empty tables give an empty result.
    """
    spark = index.blocks.sparkSession
    ids, named = index.docs.schema["doc_id"], items.schema[key].dataType
    schema = T.StructType([T.StructField("item_id", named), T.StructField("rank", T.IntegerType()), ids, T.StructField("score", T.LongType())])
    results = []
    for asked in query_groups(index, items, text, key):
        first = _ranked(_bounded(index, asked, ids, max(SEEDS, k), None), [F.col("bound").desc()], max(SEEDS, k))
        last = _ranked(_scored(index, asked, first.select("item", "doc_id")), [F.col("score").desc()], k).where(F.col("rank") == k)
        floor = np.ones(len(asked.items), np.int64)
        for r in last.select("item", "score").collect():  # one number for each item of the group
            floor[r.item] = r.score
        found = _scored(index, asked, _bounded(index, asked, ids, None, floor).select("item", "doc_id"))
        ranked = _ranked(found, [F.col("score").desc(), F.col("doc_id")], k)
        names = spark.createDataFrame(list(enumerate(asked.items)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", named)]))
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], schema)
    whole = results[0]
    for other in results[1:]:
        whole = whole.unionByName(other)
    return whole
