"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A sequence of pieces is the merge encoding of its text exactly if every two
neighbours, merged again from their characters, give themselves back. So a text
is encoded by walking over the longest matches that an Aho-Corasick automaton
finds, checking each new piece against the one before, and stepping back to a
shorter match where nothing fits. For each prefix only one encoding exists, so a
position that failed once has failed for good; a bitfield remembers it.

The library is used for nothing but reading the model file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, text_batches

SPACE = "▁"
KEPT_SEGMENTS = 200_000
KEPT_PAIRS = 400_000


class PieceCodec:
    """Encoder and decoder of one model. Models with a normalizer other than identity are refused."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models with identity normalisation are supported")
        del sentencepiece
        kind = proto.ModelProto.SentencePiece
        self.prefix = norm.add_dummy_prefix
        self.fallback = model.trainer_spec.byte_fallback
        self.bos, self.eos, self.unk = model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.unk_id
        self.ids, self.scores, self.bytes = {}, {}, [0] * 256
        self.out: list[bytes] = []  # what each id stands for
        self.raw = set()  # ids of single bytes
        for i, p in enumerate(model.pieces):
            if p.type == kind.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.out.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.raw.add(i)
                self.out.append(bytes([value]))
            elif p.type == kind.UNKNOWN:
                self.out.append(" ⁇ ".encode())
            elif p.type == kind.CONTROL:
                self.out.append(b"")
            else:
                raise ValueError(f"piece type {p.type} is not supported")
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        # Texts fall apart where no piece can reach across: before a space that follows another
        # character (if no piece holds such a place), and around line ends that no piece holds.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        body = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")
        self.segments = re.compile("(?s:.+)" if inner else body).findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merge a short text from its characters: always the best pair, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when their characters are merged again; left may be empty."""
        key = (left, right)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def split(self, text: str) -> list[str]:
        """The merge encoding of a segment, as strings."""
        n = len(text)
        ending: list[list[str]] = [[c] for c in text]  # by start; a character may always stand alone
        for end, piece in self.matcher.iter(text):
            if len(piece) > 1:
                ending[end - len(piece) + 1].append(piece)
        open_at = bytearray(b"\x01") * (n + 1)
        taken: list[tuple[str, int]] = []
        at, k = 0, -1
        while at < n:
            choices = ending[at]
            if k == -1:
                choices.sort(key=len)
                k = len(choices)
            left = taken[-1][0] if taken else ""
            while k:
                k -= 1
                piece = choices[k]
                if open_at[at + len(piece)] and self.fits(left, piece):
                    taken.append((piece, k))
                    at, k = at + len(piece), -1
                    break
            else:
                open_at[at] = 0
                piece, k = taken.pop()
                at -= len(piece)
        return [piece for piece, _ in taken]

    def packed(self, segment: str) -> bytes:
        """Ids of a segment as little-endian 32-bit integers."""
        ids: list[int] = []
        for piece in self.split(segment):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            elif self.fallback:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unk:  # a run of unknown characters is one id
                ids.append(self.unk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids of a text, packed."""
        parts = [struct.pack("<I", self.bos)] if bos else []
        if text:
            text = text.replace(" ", SPACE)
            for segment in self.segments(SPACE + text if self.prefix else text):
                if (found := self.known.get(segment)) is None:
                    if len(self.known) >= KEPT_SEGMENTS:
                        self.known.clear()
                    found = self.packed(segment)
                    if len(segment) <= 64:
                        self.known[segment] = found
                parts.append(found)
        if eos:
            parts.append(struct.pack("<I", self.eos))
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: control ids vanish, the first piece loses its leading space, bytes that are no UTF-8 become U+FFFD one by one."""
        ids = memoryview(packed).cast("I").tolist()
        out = self.out
        whole = b"".join([out[i] for i in ids])
        lead = False
        if self.prefix:
            first = next((i for i in ids if out[i]), None)
            lead = first is not None and first != self.unk and first not in self.raw and out[first][:1] == b" "
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text, run = "", b""
            for i in [*ids, None]:
                if i in self.raw:
                    run += out[i]
                    continue
                text, run = text + _lenient(run), b""
                if i is not None:
                    text += out[i].decode()
        return text[1:] if lead else text


def _lenient(run: bytes) -> str:
    text = ""
    while run:
        for n in (1, 2, 3, 4):
            try:
                text, run = text + run[:n].decode(), run[n:]
                break
            except UnicodeDecodeError:
                continue
        else:
            text, run = text + "�", run[1:]
    return text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per worker process and model."""
    return PieceCodec(path)


def encode_texts(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, `ids` (packed little-endian unsigned 32-bit integers, with begin and end id) and `decoded` (the ids turned back into text).

    One row per input row, whatever its id. A null text counts as empty: the two
    outer ids, an empty decoded text. Repeated rows are encoded each; other
    columns of docs are left out, also where they are named ids or decoded. Bytes that are no UTF-8
    count as U+FFFD. `model` is the path of the model file on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch, texts in text_batches(batches, "_text"):
            ids = [coder.encode(t.decode("utf-8", "replace") if t else "") for t in texts]
            decoded = [coder.decode(i) for i in ids]
            yield columns(batch, list(keep), {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    rows = docs.select(*(F.col(c) for c in keep), F.col(text).cast("string").alias("_text"))
    fields = [rows.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields))


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and `text`, decoded from packed ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch, packed in text_batches(batches, "_ids"):
            yield columns(batch, list(keep), {"text": pa.array([None if p is None else coder.decode(p) for p in packed], pa.string())})

    rows = encoded.select(*(F.col(c) for c in keep), F.col(ids).alias("_ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("text", T.StringType())]))


def encoding_digest(encoded: DataFrame) -> DataFrame:
    """Per row of encode_texts: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
