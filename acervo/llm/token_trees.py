"""Token counts that follow edits, by a segment tree per document.

A text is cut into leaves of about LEAF_CHARS characters at places where the
tokenizer's pre-tokens always end: before a single space between two characters
that are no space. So the tokens of a text are those of its leaves, one after
another. Two heap-shaped trees hold sums of leaf lengths and of leaf tokens. An
edit finds its leaves by descending the first; those leaves (and a neighbour
whose border the edit touches) are encoded anew, and the sums on the way to the root change.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, text_batches

LEAF_CHARS = 256
GROWN = 8  # a leaf that grew to so many times its size has the tree cut anew
NEAR = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
EDITS = "array<struct<start:int,stop:int,text:string>>"
#: What the cleaning edits replace, and by what.
REDACTED = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\bAKIA[0-9A-Z]{12,}\b|\b\d(?:[ -]?\d){8,}\b")
MARK = "[redacted]"


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """Number of tokens of a text, by the byte-level vocabulary in a file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def _solid(c: str) -> bool:
    return c.isalnum() or c in NEAR


def cut(text: str, size: int = LEAF_CHARS) -> list[int]:
    """Lengths of a text's leaves: each ends at the first safe place after `size` characters."""
    lengths, start, n = [], 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while 0 < at < n - 1 and not (_solid(text[at - 1]) and _solid(text[at + 1])):
            at = text.find(" ", at + 1)
        if not 0 < at < n - 1:
            break
        lengths.append(at - start)
        start = at
    return lengths + [n - start] if n > start else lengths


class TokenTree:
    """Leaf lengths and token counts with their sums, as heaps: node i sums nodes 2i and 2i + 1, leaves come last."""

    def __init__(self, sizes: list[int], tokens: list[int]):
        self.sizes, self.tokens = sizes, tokens

    @classmethod
    def of_leaves(cls, lengths: list[int], counts: list[int]) -> TokenTree:
        width = 1 << max(0, len(lengths) - 1).bit_length()
        heaps = []
        for leaves in (lengths, counts):
            heap = [0] * width + leaves + [0] * (width - len(leaves))
            for i in range(width - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]
            heaps.append(heap)
        return cls(*heaps)

    @classmethod
    def of_text(cls, text: str, count: Callable[[str], int]) -> TokenTree:
        lengths, at, counts = cut(text), 0, []
        for n in lengths:
            counts.append(count(text[at : at + n]))
            at += n
        return cls.of_leaves(lengths, counts)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf (node number) that holds a character, and where it starts; the last filled leaf for places behind the end."""
        node, start, width = 1, 0, len(self.sizes) // 2
        place = min(place, self.sizes[1] - 1)
        while node < width:
            node *= 2
            if place - start >= self.sizes[node]:
                start += self.sizes[node]
                node += 1
        return node, start

    def _set(self, leaf: int, size: int, tokens: int) -> None:
        ds, dt = size - self.sizes[leaf], tokens - self.tokens[leaf]
        while leaf and (ds or dt):
            self.sizes[leaf] += ds
            self.tokens[leaf] += dt
            leaf //= 2

    def edit(self, text: str, start: int, stop: int, new: str, count: Callable[[str], int]) -> tuple[str, int]:
        """Replace text[start:stop]; gives the new text and how many characters were encoded."""
        if not self.sizes[1]:
            fresh = TokenTree.of_text(new, count)
            self.sizes, self.tokens = fresh.sizes, fresh.tokens
            return new, len(new)
        first, begin = self.leaf_at(max(0, start - 1))
        if begin > start - 2 and begin > 0:  # the edit touches what made its leaf's start a safe place
            first, begin = self.leaf_at(begin - 1)
        last, end = self.leaf_at(max(start, stop - 1))
        end += self.sizes[last]
        if end < stop + 1 and end < len(text):
            last, end = self.leaf_at(end)
            end += self.sizes[last]
        region = text[begin:start] + new + text[stop:end]
        whole = text[:begin] + region + text[end:]
        lengths, slots = cut(region), last - first + 1
        if len(lengths) > slots:  # more leaves than before: the last one takes the rest
            lengths = lengths[: slots - 1] + [sum(lengths[slots - 1 :])]
        at = 0
        for k in range(slots):
            n = lengths[k] if k < len(lengths) else 0
            self._set(first + k, n, count(region[at : at + n]))
            at += n
        if lengths and lengths[-1] > GROWN * LEAF_CHARS and len(cut(region[at - lengths[-1] :])) > 1:
            self._recut(whole, first + min(slots, len(lengths)) - 1, count)
            return whole, len(region) + lengths[-1]
        return whole, len(region)

    def _recut(self, text: str, leaf: int, count: Callable[[str], int]) -> None:
        """Cut one grown leaf into several; the others keep their counts."""
        width = len(self.sizes) // 2
        lengths, counts, at = [], [], 0
        for node in range(width, 2 * width):
            n = self.sizes[node]
            if node == leaf:
                for part in cut(text[at : at + n]):
                    lengths.append(part)
                    counts.append(count(text[at : at + part]))
                    at += part
            elif n:
                lengths.append(n)
                counts.append(self.tokens[node])
                at += n
        fresh = TokenTree.of_leaves(lengths, counts)
        self.sizes, self.tokens = fresh.sizes, fresh.tokens


def count_trees(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, text, n_tokens and the tree of each row: sizes and tokens, heaps of sums.

    Null and empty texts have 0 tokens and an empty tree. Repeated rows have a
    tree each; other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch, texts in text_batches(batches, "_text"):
            trees = [TokenTree.of_text(t.decode("utf-8", "replace") if t else "", count) for t in texts]
            yield columns(batch, ["_key", "_text"], {
                "n_tokens": pa.array([t.total for t in trees], pa.int64()),
                "sizes": pa.array([t.sizes for t in trees], pa.list_(pa.int32())), "tokens": pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
            })

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    more = T.StructType.fromDDL("n_tokens bigint, sizes array<int>, tokens array<int>").fields
    done = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))
    return done.select(F.col("_key").alias(key), F.col("_text").alias(text), "n_tokens", "sizes", "tokens")


def with_edits(trees: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Trees and the column edits, gathered from rows (key, start, stop, text) that count characters of the text as it is.

    Keys of trees must not repeat. A document's edits must not overlap.
    """
    each = edits.select(F.col(key), F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("text").cast("string").alias("text")).alias("e"))
    return trees.join(each.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("edits")), key, "left")


def apply_edits(trees: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", edits: str = "edits") -> DataFrame:
    """The trees after their edits: key, text, n_tokens, sizes, tokens, n_edits, encoded_chars (characters that were encoded again).

    Edits (start, stop, text) replace text[start:stop] and count characters of the
    text before all edits; they are cut to its length. A null text counts as empty, null edits as none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch, texts in text_batches(batches, text):
            lists = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("sizes", "tokens", edits)}
            out = []
            for t, sizes, tokens, changes in zip(texts, lists["sizes"], lists["tokens"], lists[edits]):
                body, tree, encoded = t.decode("utf-8", "replace") if t else "", TokenTree(sizes, tokens), 0
                for e in sorted(changes or [], key=lambda e: (-e["start"], -e["stop"])):
                    start = min(e["start"], len(body))
                    body, n = tree.edit(body, start, max(start, min(e["stop"], len(body))), e["text"] or "", count)
                    encoded += n
                out.append((body, tree.total, tree.sizes, tree.tokens, len(changes or []), encoded))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64())
            names = (text, "n_tokens", "sizes", "tokens", "n_edits", "encoded_chars")
            yield columns(batch, [key], {n: pa.array([o[k] for o in out], kind) for k, (n, kind) in enumerate(zip(names, kinds))})

    rows = trees.select(key, text, "sizes", "tokens", F.col(edits).cast(EDITS).alias(edits))
    more = T.StructType.fromDDL("n_tokens bigint, sizes array<int>, tokens array<int>, n_edits int, encoded_chars bigint").fields
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField(text, T.StringType()), *more]))


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask addresses, keys and long numbers, and take out lines that repeat an earlier line of the text."""
    edits = []
    seen, at = set(), 0
    for line in text.split("\n"):
        stripped = line.strip()
        if stripped and stripped in seen:
            edits.append((at - 1, at + len(line), ""))
        else:
            seen.add(stripped)
            edits += [(at + m.start(), at + m.end(), MARK) for m in REDACTED.finditer(line)]
        at += len(line) + 1
    return edits


def with_cleaning_edits(trees: DataFrame, text: str = "text") -> DataFrame:
    """Trees with the column edits of cleaning_edits."""
    names = [c for c in trees.columns if c != "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text):
            found = [[{"start": a, "stop": b, "text": new} for a, b, new in cleaning_edits(t.decode("utf-8", "replace"))] if t else [] for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
            yield columns(batch, names, {"edits": pa.array(found, kind)})

    rows = trees.select(names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("edits", T._parse_datatype_string(EDITS))]))
