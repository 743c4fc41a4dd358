"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Merges never cross the matches of the split pattern, its words. So a text's ids
are those of its words, one after another, and a word has the same ids wherever
it stands. Texts are taken in blocks: a block is exploded into its
distinct words, numbered by first appearance, and for each text the word
numbers by position. The words of all blocks are dealt to buckets by their hash; a bucket
encodes each distinct word once. The ids return to their blocks, and the
positions put them in order.

What travels is packed: a block sends each bucket its words as one value. A word meets its
bucket once for each block that holds it, however often the texts repeat it, so no word is
hot. Decoding joins the table of token bytes, which is as long as the vocabulary file.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_width
from .shared import columns, stored_by, text_batches

BLOCK_BYTES = 8 << 20  # of text, about, in a block; a longer text is a block of its own
BUCKETS = 4  # of words, for each shuffle partition
OUT_BYTES = 2 << 20  # of ids in a batch that leaves a block
SHORT = 48  # words up to so many bytes are merged by plain scans
MAX_VOCABULARY = 1 << 21  # longer tables of token bytes are refused, not broadcast


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: a base64 text and a number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    return read_ranks(path)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the neighbours of least rank, the left ones of equals, until none has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs over a chain of pieces, in n log n."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    stop = list(range(1, n + 1))  # end of the piece that starts here; 0 once it was merged away

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : stop[j]])) is not None:
            heapq.heappush(heap, (rank, i, stop[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if stop[i] else n
        if j >= n or stop[j] != end:
            continue  # one of the two has changed since
        stop[i], stop[j], after[i] = end, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : stop[i]]])
        i = after[i]
    return ids


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Whole numbers in groups of seven bits, low ones first, the top bit set where more follow."""
    numbers = numbers.astype(np.uint32)
    size = np.ones(len(numbers), np.int64)
    for j in range(1, 5):
        size += numbers >= 1 << 7 * j
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(5):
        at = np.flatnonzero(size > j)
        if not len(at):
            break
        out[start[at] + j] = (numbers[at] >> np.uint32(7 * j)) & 127 | (size[at] > j + 1) * 128
    return out.tobytes()


def unpack_numbers(packed: bytes) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8)
    end = np.flatnonzero(data < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    numbers = (data[start] & 127).astype(np.int64)
    for j in range(1, 5):
        at = np.flatnonzero(end - start >= j)
        if not len(at):
            break
        numbers[at] |= (data[start[at] + j] & 127).astype(np.int64) << 7 * j
    return numbers


def pack_parts(counts: np.ndarray, body: bytes) -> bytes:
    """Lengths of parts and the parts one after another, compressed."""
    head = pack_numbers(counts)
    return zstandard.ZstdCompressor().compress(len(head).to_bytes(4, "little") + head + body)


def unpack_parts(packed: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    size = 4 + int.from_bytes(data[:4], "little")
    return unpack_numbers(data[4:size]), data[size:]


class _Numbers(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def explode_words(docs: DataFrame, pattern: str, text: str, keep: tuple[str, ...], buckets: int) -> DataFrame:
    """One table of three kinds of rows, all with their block.

    (bucket, words): a block's distinct words of a bucket, by number. (keep, places): some texts of the
    block with the word numbers by position. (order): the bucket of each of the block's words, by number.
    """
    rows = docs.select(F.struct(*(F.col(c) for c in keep)).alias("keep"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("keep", T.ArrayType(rows.schema["keep"].dataType)),
        T.StructField("places", T.BinaryType()),
        T.StructField("order", T.BinaryType()),
    ])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block, size, seen, kind = TaskContext.get().partitionId() << 32, 0, _Numbers(), None

        def batch_of(n: int, **given: pa.Array) -> pa.RecordBatch:
            types = {"bucket": pa.int32(), "keep": pa.list_(kind)}
            given["block"] = pa.repeat(pa.scalar(block, pa.int64()), n)
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, types.get(c, pa.binary()))) for c in names], names)

        def listed() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list[bytes]] = {}
            order = np.empty(len(seen), np.int64)
            for i, word in enumerate(seen):
                data = word.encode()
                order[i] = bucket = zlib.crc32(data) % buckets
                dealt.setdefault(bucket, []).append(data)
            packed = [pack_parts(np.fromiter(map(len, found), np.int64, len(found)), b"".join(found)) for found in dealt.values()]
            if packed:
                yield batch_of(len(packed), bucket=pa.array(list(dealt), pa.int32()), words=pa.array(packed, pa.binary()))
            yield batch_of(1, order=pa.array([zstandard.ZstdCompressor().compress(pack_numbers(order))], pa.binary()))

        for batch, texts in text_batches(batches, "_text"):
            kind = batch.column(0).type
            length = sum(len(t or b"") for t in texts)
            if size and size + length > BLOCK_BYTES:
                yield from listed()
                block, size, seen = block + 1, 0, _Numbers()
            found = [np.fromiter(map(seen.__getitem__, find(t.decode("utf-8", "replace")) if t else ()), np.int64) for t in texts]
            places = pack_parts(np.fromiter(map(len, found), np.int64, len(found)), pack_numbers(np.concatenate(found)))
            kept = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(0))
            yield batch_of(1, keep=kept, places=pa.array([places], pa.binary()))
            size += length
        if kind is not None:
            yield from listed()

    return rows.mapInArrow(run, schema)


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(block, bucket, ids) of (block, bucket, words): in its bucket each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, at, known = ranks_of(vocabulary), None, {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                lengths, body = unpack_parts(packed)
                ends = np.cumsum(lengths).tolist()
                found = []
                for start, end in zip([0, *ends[:-1]], ends, strict=True):
                    word = body[start:end]
                    if (ids := known.get(word)) is None:
                        ids = known[word] = merge_word(word, ranks)
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.int64, len(found))
                out.append(pack_parts(counts, pack_numbers(np.array([i for ids in found for i in ids], np.int64))))
            yield columns(batch, ["block", "bucket"], {"ids": pa.array(out, pa.binary())})

    met = words.select("block", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(run, "block long, bucket int, ids binary")


def _spread(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + length[i]] for all i, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and `ids`: a text's ids as packed little-endian unsigned 32-bit integers.

    One row per input row, whatever its id; repeated rows are encoded each. A null or
    empty text gives empty ids. Other columns of docs are left out, so names may
    clash with none; keep may not hold a column `ids`. Bytes that are no UTF-8 count as U+FFFD.
    A very long text is a block of its own. An empty table gives an empty one.
    Special tokens are ordinary text. `vocabulary` is the path of the rank file on every worker;
    `pattern` splits the text and is by default that of the public tokenizers.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    width = shuffle_width(docs.sparkSession)
    # positions are many: they are written by block once and need no shuffle to meet the ids of their words
    exploded = stored_by(explode_words(docs, pattern, text, keep, BUCKETS * width), "block", width)
    words = encode_words(exploded.where("words is not null"), vocabulary)
    texts = exploded.where("words is null").select("block", "keep", "places", "order")
    kept = exploded.schema["keep"].dataType.elementType
    schema = T.StructType([T.StructField("keep", kept), T.StructField("ids", T.BinaryType())])

    def assemble(words: pa.Table, texts: pa.Table) -> pa.Table:
        words = words.sort_by("bucket")
        parts = [unpack_parts(p) for p in words.column("ids").to_pylist()]
        empty = np.empty(0, np.int64)
        counts = np.concatenate([p[0] for p in parts] or [empty])
        flat = np.concatenate([unpack_numbers(p[1]) for p in parts] or [empty]).astype("<u4")
        order = next(o for o in texts.column("order").to_pylist() if o is not None)
        numbers = np.argsort(unpack_numbers(zstandard.ZstdDecompressor().decompress(order)), kind="stable")  # of the words as they come
        length, start = np.empty_like(counts), np.empty_like(counts)
        length[numbers], start[numbers] = counts, np.cumsum(counts) - counts
        texts = texts.filter(texts.column("places").is_valid())
        rows, done, out, size = texts.column("keep").combine_chunks().flatten(), 0, [], 0
        batches = []

        def cut() -> None:
            nonlocal done, out, size
            batches.append(pa.RecordBatch.from_arrays([rows.slice(done, len(out)), pa.array(out, pa.binary())], ["keep", "ids"]))
            done, out, size = done + len(out), [], 0

        for packed in texts.column("places").to_pylist():
            sizes, body = unpack_parts(packed)
            for at in np.split(unpack_numbers(body), np.cumsum(sizes)[:-1]):
                out.append(_spread(flat, start[at], length[at]).tobytes())
                size += len(out[-1])
                if size > OUT_BYTES:
                    cut()
        cut()
        return pa.Table.from_batches(batches)

    done = words.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(assemble, schema)
    return done.select(*(F.col("keep")[c].alias(c) for c in keep), "ids")


def token_bytes(spark: SparkSession, vocabulary: str) -> DataFrame:
    """The table (id, bytes) of a vocabulary file."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in read_ranks(vocabulary).items()], "id int, bytes binary")


def decode_ids(encoded: DataFrame, tokens: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and `decoded`: the bytes of packed ids, joined with the table `tokens` (id, bytes).

    The table is no longer than a vocabulary (MAX_VOCABULARY is checked), so it goes to
    every worker and each position of a row's ids meets its bytes there. Bytes need
    not be UTF-8, as ids may cut a character. Null ids give null, empty ids an empty value; an id that
    the table lacks is an error. Repeated rows are decoded each.
    """
    rows = tokens.select("id", "bytes").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens are no vocabulary")
    size = 1 + max((r.id for r in rows), default=-1)
    table: list[bytes | None] = [None] * size
    for r in rows:
        table[r.id] = bytes(r.bytes)
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, packed in text_batches(batches, "_ids"):
            out = [None if p is None else b"".join([known[i] for i in np.frombuffer(p, "<u4").tolist()]) for p in packed]
            yield columns(batch, list(keep) + ["_ids"], {"decoded": pa.array(out, pa.binary())})

    rows = encoded.select(*(F.col(c) for c in keep), F.col(ids).alias("_ids"))
    fields = [rows.schema[c] for c in keep] + [T.StructField("_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    done = rows.mapInArrow(run, T.StructType(fields))
    return done.withColumnRenamed("_ids", ids)


def encoding_digest(decoded: DataFrame) -> DataFrame:
    """Per row with ids and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
