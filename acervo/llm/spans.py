"""Substring dedup over sliding runs of sentences.

Sentences end at stops followed by white space and at line ends. From every
sentence on, and back from every sentence, the shortest run of at least
MIN_SENTENCES sentences with MIN_WORDS words is hashed. Runs are joined globally
by hash; sentences that any but the first occurrence of a repeated run covers
are removed. Runs this long do not repeat by chance.

A passage may lie in one long sentence, have no stops, or begin and end inside
sentences. So with `cut_long`, sentences of over LONG words are also cut into pieces, at places
that the words around them decide (winnowing), and from every piece on, the
shortest run of pieces with MIN_WORDS words is hashed as well. Each end of a
shared passage loses at most 8 words until the pieces agree, and a run has at most 32:
any 50 words that two texts share hold a whole common run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jaccard import MULTIPLIER, mixed
from .shared import columns, covered, dropped, stored, text_batches

MIN_SENTENCES, MIN_WORDS = 2, 25
LONG, GRAM, WITHIN = 8, 3, 6  # 3 * max(LONG, GRAM + WITHIN - 1) + MIN_WORDS - 1 is at most 50
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STOP = re.compile(rb"[.!?]+[\"')\]]*(?=[ \t-\r])|\n|\xe3\x80\x82|\xef\xbc[\x81\x9f]")
BACK = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
KEPT_POWERS = 1 << 14
RUN_BYTES = 1 << 20  # of text at once: its runs take several times that
ARROW_TEXTS = 1000  # rows of a batch of texts


def _powers(of: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, of)
    steps[:1] = 1
    return np.cumprod(steps)


POWERS = {int(of): _powers(of, KEPT_POWERS) for of in (MULTIPLIER, BACK)}


def powers(of: np.uint64, n: int) -> np.ndarray:
    """The first n powers, modulo 2^64; KEPT_POWERS of them are at hand."""
    return POWERS[int(of)][:n] if n <= KEPT_POWERS else _powers(of, n)


def sentences(text: bytes) -> tuple[list[int], list[int], list[int], list[bytes], np.ndarray]:
    """Start of each sentence, its number of words, its hash (lower case, white space as one space); all words and their starts."""
    starts, counts, hashes, at, low = [], [], [], 0, text.lower()
    words: list[bytes] = []
    for end in [m.end() for m in STOP.finditer(text)] + [len(text)]:
        found = low[at:end].split()
        if found:
            starts.append(at)
            counts.append(len(found))
            hashes.append(xxhash.xxh64_intdigest(b" ".join(found)))
            words += found
            at = end
    # a word begins after a space, and where a sentence does without one
    inside = np.concatenate([SPACE[:1], ~SPACE[np.frombuffer(text, np.uint8)]])
    begin = inside[1:] & ~inside[:-1]
    begin[starts] = inside[1:][starts]
    return starts, counts, hashes, words, np.flatnonzero(begin)


def pieces(words: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word; the words that begin a piece, and the number of words.

    A sentence begins a piece. One of over LONG words is also cut before the
    least hash of GRAM words among each WITHIN that follow one another.
    """
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    sizes = np.array(counts, np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    if len(codes) < GRAM + WITHIN - 1:
        return codes, edges
    grams = codes[: len(codes) - GRAM + 1].copy()
    for k in range(1, GRAM):
        grams = grams * MULTIPLIER + codes[k : len(codes) - GRAM + 1 + k]
    windows = np.lib.stride_tricks.sliding_window_view(mixed(grams)[::-1], WITHIN)
    found = len(grams) - 1 - (np.arange(len(windows)) + windows.argmin(1))  # of equal hashes the last word
    cuts = np.zeros(len(codes) + 1, bool)
    cuts[found] = np.repeat(sizes > LONG, sizes)[found]
    cuts[edges] = True
    return codes, np.flatnonzero(cuts)


def _run_hashes(codes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hash of the codes from each of the first to before the second beside it."""
    first, end = pairs
    scaled = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(MULTIPLIER, len(codes)), out=scaled[1:])
    return mixed((scaled[end] - scaled[first]) * powers(BACK, len(codes))[first] + (end - first).astype(np.uint64))


def runs(text: bytes, cut_long: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every run of a text; a run ends where the next sentence or piece starts."""
    starts, counts, hashes, words, begins = sentences(text)
    n = len(starts)
    total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    if total[-1] < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.arange(n)
    stop = np.maximum(first + MIN_SENTENCES, np.searchsorted(total, total[:-1] + MIN_WORDS))
    back = np.minimum(first + 1 - MIN_SENTENCES, np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1)
    on, before = stop <= n, (back >= 0) & (total[1:] >= MIN_WORDS)
    whole = np.sort(np.concatenate([first[on] * (n + 1) + stop[on], back[before] * (n + 1) + first[before] + 1]))
    pairs = np.divmod(whole[np.concatenate([whole[:1] >= 0, whole[1:] != whole[:-1]])], n + 1)
    codes, edges = pieces(words, counts) if cut_long else (np.empty(0, np.uint64), np.zeros(1, np.int64))
    ends = np.searchsorted(edges, edges[:-1] + MIN_WORDS)
    whole_pieces = ends < len(edges)
    inner = edges[:-1][whole_pieces], edges[ends[whole_pieces]]
    width, spans = len(words) + 1, (total[pairs[0]], total[pairs[1]])
    if len(spans[0]) and len(inner[0]):
        taken, own = np.sort(spans[0] * width + spans[1]), inner[0] * width + inner[1]
        new = taken[np.minimum(np.searchsorted(taken, own), len(taken) - 1)] != own  # not the runs of sentences again
        inner = inner[0][new], inner[1][new]
    h = np.concatenate([_run_hashes(np.array(hashes, np.uint64), pairs), _run_hashes(codes, inner)])
    at = np.concatenate([begins, [len(text)]])
    at[total] = [*starts, len(text)]
    return h.view(np.int64), at[np.concatenate([spans[0], inner[0]])], at[np.concatenate([spans[1], inner[1]])]


def _all_runs(rows: DataFrame, cut_long: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "_text", RUN_BYTES):
            found = [runs(t or b"", cut_long) for t in texts]
            place = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
            hashes, begins, ends = (np.concatenate([f[k] for f in found]) for k in range(3))
            yield columns(batch.select(["_key", "_print"]).take(pa.array(place)), ["_key", "_print"], {"run": pa.array(hashes), "begin": pa.array(begins, pa.int32()), "size": pa.array(ends - begins, pa.int32())})

    more = "run bigint, begin int, size int"
    return rows.mapInArrow(run, T.StructType([rows.schema["_key"], rows.schema["_print"], *T.StructType.fromDDL(more).fields]))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", cut_long: bool = False) -> DataFrame:
    """Byte spans to remove: key, _print (hash of the text), spans (sorted array of begin, end), one row per touched document.

    The first occurrence is the one in the smallest key (null last), there the one that begins first.
    Rows equal in key and text count as one document.
    """
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text).cast("string")).alias("_print"), F.col(text).cast("string").alias("_text"))
    found = stored(_all_runs(rows, cut_long), ARROW_TEXTS)
    # the small sides are written, so that both sides of the joins are plain shuffles and a hot run can be split
    twice = stored(found.groupBy("run").count().where("count > 1").select("run"))
    place = F.shiftleft(F.col("begin").cast("long"), 32) + F.col("size")  # one number is shuffled for both, with few bytes that are not zero
    again = stored(found.select("_key", "_print", "run", place.alias("place")).join(twice, "run"))
    dropped(found, twice)
    begin = F.shiftright("place", 32)
    again = again.select("_key", "_print", "run", begin.alias("begin"), (begin + F.col("place").bitwiseAND((1 << 32) - 1)).alias("end"))
    order = F.struct(F.col("_key").isNull().alias("none"), "_key", "_print", "begin")
    first = stored(again.groupBy("run").agg(F.min(order).alias("first")))
    later = again.join(first, "run").where(order > F.col("first"))
    return later.groupBy("_key", "_print").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))


def without(text: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The text without the spans, which may overlap, and the number of bytes taken out."""
    kept, at, gone = [], 0, 0
    for s in spans:
        if s["end"] <= at:
            continue
        begin = max(at, s["begin"])
        kept.append(text[at:begin])
        gone += s["end"] - begin
        at = s["end"]
    kept.append(text[at:])
    return b"".join(kept).strip(), gone


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", marks: bool = False, cut_long: bool = False) -> DataFrame:
    """The rows and columns of docs with repeated sentences taken out of the text; with `cut_long`, repeated pieces of long sentences too.

    Touched texts are also stripped at both ends; a text may become empty, its row stays.
    Null and empty texts stay as they are. With
    `marks`, the columns spans (null where nothing goes) and removed_bytes follow, in place of any columns so named.
    Other columns may have any names. An empty table gives an empty one.
    """
    own = [c for c in docs.columns if not (marks and c in ("spans", "removed_bytes"))]
    plain, named = covered(docs.select(*(F.col(c) for c in own)))
    done = _without_repeats(plain, named[text], named[key], marks, cut_long)
    return done.toDF(*own, *(("spans", "removed_bytes") if marks else ()))


def _without_repeats(docs: DataFrame, text: str, key: str, marks: bool, cut_long: bool) -> DataFrame:
    spans = repeated_spans(docs, text, key, cut_long).withColumnRenamed("_key", "_span_key").withColumnRenamed("_print", "_span_print")
    names = docs.columns
    rows = docs.select("*", F.xxhash64(F.col(text).cast("string")).alias("_row_print"))
    same = F.col(key).eqNullSafe(F.col("_span_key")) & (F.col("_row_print") == F.col("_span_print"))
    joined = rows.join(spans.withColumnRenamed("spans", "_spans").hint("shuffle_hash"), same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text, RUN_BYTES):
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            done = [(t, 0) if s is None or t is None else without(t, s) for t, s in zip(texts, spans)]
            kept = columns(batch, names, {})
            place = kept.schema.get_field_index(text)
            kept = kept.set_column(place, text, pa.array([d[0] for d in done], pa.binary()).cast(kept.schema.field(text).type))
            if marks:
                kept = kept.append_column("spans", batch.column(batch.schema.get_field_index("_spans")))
                kept = kept.append_column("removed_bytes", pa.array([d[1] for d in done], pa.int64()))
            yield kept

    fields = [docs.schema[c] for c in names]
    if marks:
        fields += [T.StructField("spans", joined.schema["_spans"].dataType), T.StructField("removed_bytes", T.LongType(), False)]
    return joined.drop("_span_key", "_span_print", "_row_print").mapInArrow(run, T.StructType(fields))
