"""Toxicity of whole texts, by a bidirectional gated recurrent network in numpy.

A token is a run of anything but white space, in lower case, cut every
MAX_CHARS characters. Its input is a hashed word vector beside the end states of
a bidirectional gated network over its characters. A second bidirectional gated
network reads windows of WINDOW tokens that overlap by WINDOW - STRIDE; attention
pools each window into one logit, and a text's logit is the largest of its windows.

Training runs on a bounded sample of labelled texts (TRAIN_ROWS), on the driver;
scoring covers every window of every text, in tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, text_batches

WINDOW, STRIDE = 48, 36
MAX_CHARS = 24
CHARS, WORDS = 512, 4096  # rows of the hashed character and word vectors
CHAR_DIM, CHAR_STATE, WORD_DIM, STATE, ATTENTION = 8, 8, 8, 8, 8
TRAIN_ROWS = 3000  # most labelled texts a model is fitted on, at most half of them of the rarer label
TRAIN_CHARS = 50_000  # longer texts are not learned from (they are scored like all others)
ROUNDS, BATCH, RATE = 12, 128, 0.012
DROPPED = 0.5  # share of tokens that a training step reads by their characters alone
LEAST_STEPS = 16  # of each round; small samples are gone through more often
KEPT_WORDS = 250_000  # tokens whose inputs a worker keeps
PAD_GATE = 30.0  # update gate of padding: the state stays as it is
EDGES = ".,;:!?\"'()[]{}*_-<>"

Params = dict[str, np.ndarray]


def tokens(text: str) -> list[str]:
    found = text.lower().split()
    if text and max(map(len, found), default=0) > MAX_CHARS:
        return [w[i : i + MAX_CHARS] for w in found for i in range(0, len(w), MAX_CHARS)]
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def start_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    shape = {"char": (CHARS, CHAR_DIM), "word": (WORDS, WORD_DIM), "attend": (2 * STATE, ATTENTION), "attend_v": (ATTENTION,), "out": (2 * STATE,)}
    for side in "fb":
        shape |= {f"cw{side}": (CHAR_DIM, 3 * CHAR_STATE), f"cu{side}": (CHAR_STATE, 3 * CHAR_STATE)}
        shape |= {f"ww{side}": (WORD_DIM + 2 * CHAR_STATE, 3 * STATE), f"wu{side}": (STATE, 3 * STATE)}
    p = {k: rng.normal(0, 0.3 if k in ("char", "word") else 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    for side in "fb":
        p[f"cb{side}"], p[f"wb{side}"] = np.zeros(3 * CHAR_STATE), np.zeros(3 * STATE)
    p["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def gru(x: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (time, rows, size) of a gated network over its input terms x (time, rows, 3 sizes)."""
    size = u.shape[0]
    state = np.zeros((x.shape[1], size), np.float32)
    states, past = np.empty((x.shape[0], x.shape[1], size), np.float32), []
    for t in range(x.shape[0]):
        h = state @ u
        gates = sigmoid(x[t, :, : 2 * size] + h[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        n = np.tanh(x[t, :, 2 * size :] + r * h[:, 2 * size :])
        if keep:
            past.append((state, z, r, n, h[:, 2 * size :]))
        state = n + z * (state - n)
        states[t] = state
    return states, past


def gru_gradient(d_states: np.ndarray, past: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u for gradients of all states."""
    size = u.shape[0]
    dx, du = np.empty((*d_states.shape[:2], 3 * size), np.float32), np.zeros_like(u)
    carry = np.zeros_like(d_states[0])
    for t in range(len(past) - 1, -1, -1):
        state, z, r, n, c = past[t]
        d = d_states[t] + carry
        da_n = d * (1 - z) * (1 - n * n)
        da_z = d * (state - n) * z * (1 - z)
        da_r = da_n * c * r * (1 - r)
        dx[t] = np.concatenate([da_z, da_r, da_n], 1)
        dh = np.concatenate([da_z, da_r, da_n * r], 1)
        du += state.T @ dh
        carry = d * z + dh @ u.T
    return dx, du


def char_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character rows (words, longest; -1 for none), lengths and word rows of tokens."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.where(points < 384, points, 384 + points % (CHARS - 384)).astype(np.int32)
    codes = np.full((len(words), max(1, int(lengths.max(initial=1)))), -1, np.int32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    rows = np.fromiter((zlib.crc32(w.strip(EDGES).encode("utf-8", "surrogatepass")) % WORDS for w in words), np.int64, len(words))
    return codes, lengths, rows


def padded(x: np.ndarray, none: np.ndarray, size: int) -> np.ndarray:
    """Input terms where padding leaves the state unchanged."""
    x[none, :size] = PAD_GATE
    x[none, size:] = 0
    return x


def word_inputs(p: Params, words: list[str], keep: bool = False, use: np.ndarray | None = None):
    """Input terms of the two directions of the second network for tokens; with keep also what the gradient needs. `use`: 0 for tokens without their word vector."""
    codes, _, rows = char_codes(words)
    by_time, none = codes.T, codes.T < 0
    ends, past = [], []
    for side in "fb":
        x = padded((p["char"] @ p[f"cw{side}"] + p[f"cb{side}"])[by_time], none, CHAR_STATE)
        states, kept = gru(x if side == "f" else x[::-1], p[f"cu{side}"], keep)
        ends.append(states[-1])
        past.append(kept)
    vector = np.concatenate([p["word"][rows] if use is None else p["word"][rows] * use[:, None], *ends], 1)
    terms = [vector @ p[f"ww{side}"] + p[f"wb{side}"] for side in "fb"]
    return terms, (codes, rows, vector, past) if keep else None


def window_logits(p: Params, terms: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window (rows of ids, by time in columns; mask: not padding)."""
    by_time, none = ids.T, ~mask.T
    states, past = [], []
    for side, term in zip("fb", terms):
        x = padded(term[by_time], none, STATE)
        s, kept = gru(x if side == "f" else x[::-1], p[f"wu{side}"], keep)
        states.append(s if side == "f" else s[::-1])
        past.append(kept)
    both = np.concatenate(states, 2)
    hidden = np.tanh(both @ p["attend"])
    score = np.where(none, -1e9, hidden @ p["attend_v"])
    weight = np.exp(score - score.max(0))
    weight = np.where(none, 0, weight).astype(np.float32)
    weight /= np.maximum(weight.sum(0), 1e-9)
    context = np.einsum("tn,tns->ns", weight, both)
    logit = context @ p["out"] + p["bias"]
    return logit, (both, hidden, weight, context, past) if keep else None


def sums_at(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by place."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(places):
        order = np.argsort(places, kind="stable")
        ordered = places[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[begins]] = np.add.reduceat(values[order], begins)
    return out


def gradient(p: Params, words: list[str], ids: np.ndarray, mask: np.ndarray, wanted: np.ndarray, cost: np.ndarray, use: np.ndarray) -> Params:
    """Gradient of the weighted mean log loss of windows."""
    terms, (codes, rows, vector, char_past) = word_inputs(p, words, True, use)
    logit, (both, hidden, weight, context, past) = window_logits(p, terms, ids, mask, True)
    g: Params = {}
    d_logit = ((sigmoid(logit) - wanted) * cost / cost.sum()).astype(np.float32)
    g["bias"], g["out"] = d_logit.sum(keepdims=True), context.T @ d_logit
    d_context = d_logit[:, None] * p["out"]
    d_weight = np.einsum("ns,tns->tn", d_context, both)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["attend_v"] = np.einsum("tn,tna->a", d_score, hidden)
    d_hidden = d_score[:, :, None] * p["attend_v"] * (1 - hidden * hidden)
    g["attend"] = np.einsum("tns,tna->sa", both, d_hidden)
    d_both = weight[:, :, None] * d_context + d_hidden @ p["attend"].T
    d_vector, flat, there = np.zeros_like(vector), ids.T.ravel(), mask.T
    for k, side in enumerate("fb"):
        d_states = d_both[:, :, k * STATE : (k + 1) * STATE]
        dx, g[f"wu{side}"] = gru_gradient(d_states if side == "f" else d_states[::-1], past[k], p[f"wu{side}"])
        dx = (dx if side == "f" else dx[::-1]) * there[:, :, None]
        d_term = sums_at(flat, dx.reshape(-1, 3 * STATE), len(words))
        g[f"ww{side}"], g[f"wb{side}"] = vector.T @ d_term, d_term.sum(0)
        d_vector += d_term @ p[f"ww{side}"].T
    g["word"], g["char"] = sums_at(rows, d_vector[:, :WORD_DIM] * use[:, None], WORDS), np.zeros_like(p["char"])
    for k, side in enumerate("fb"):
        d_states = np.zeros((codes.shape[1], len(words), CHAR_STATE), np.float32)
        d_states[-1] = d_vector[:, WORD_DIM + k * CHAR_STATE : WORD_DIM + (k + 1) * CHAR_STATE]
        dx, g[f"cu{side}"] = gru_gradient(d_states, char_past[k], p[f"cu{side}"])
        dx = dx if side == "f" else dx[::-1]
        known = codes.T >= 0
        d_char = sums_at(codes.T[known], dx[known], CHARS)
        g[f"cw{side}"], g[f"cb{side}"] = p["char"].T @ d_char, d_char.sum(0)
        g["char"] += d_char @ p[f"cw{side}"].T
    return g


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the joined tokens (windows, WINDOW), mask, and the text of each window; an empty text has one empty window."""
    counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(lengths) - lengths
    inside = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    mask = inside < lengths[text][:, None]
    return np.where(mask, first[text][:, None] + inside, 0), mask, text


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Params:
    """Fit on labelled texts: first on random windows of each, then on the window that speaks loudest."""
    p, rng = start_params(seed), np.random.default_rng(seed)
    positive = float(labels.sum())
    if not 0 < positive < len(labels):  # one label only: its share, whatever the text
        p["out"][:] = 0
        p["bias"][:] = np.log((positive + 1) / (len(labels) - positive + 1))
        return p
    vocabulary: dict[str, int] = {}
    split = [[vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)] for t in texts]
    names = list(vocabulary)
    lengths = np.array([len(s) for s in split])
    flat = np.array([i for s in split for i in s] or [0], np.int64)
    place, mask, text = windows(lengths)
    ids = flat[place]
    begins = np.searchsorted(text, np.arange(len(texts) + 1))
    cost = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive))).astype(np.float32)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    least = max(1, round(LEAST_STEPS / (len(texts) / BATCH)))
    for turn in range(ROUNDS):
        if turn < 3:
            picks = [np.concatenate([begins[:-1] + (rng.random(len(texts)) * np.diff(begins)).astype(int) for _ in range(2)]) for _ in range(least)]
        else:
            logit = all_logits(p, names, ids, mask)
            order = np.lexsort((-logit, text))
            top = order[begins[:-1]]
            picks = [np.concatenate([top, begins[:-1] + (rng.random(len(texts)) * np.diff(begins)).astype(int)]) for _ in range(least)]
            n = len(texts)
        for pick in picks:
            if turn >= 3:  # random windows of label 1 prove nothing; keep those of label 0
                pick = np.concatenate([pick[:n], pick[n:][labels[text[pick[n:]]] == 0]])
            for at in np.array_split(rng.permutation(pick), max(1, len(pick) // BATCH)):
                used, local = np.unique(ids[at], return_inverse=True)
                local = local.reshape(ids[at].shape)
                chosen = [names[i] for i in used] or [""]
                use = (rng.random(len(chosen)) >= DROPPED).astype(np.float32)
                g = gradient(p, chosen, local, mask[at], labels[text[at]].astype(np.float32), cost[text[at]], use)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                rate = RATE * min(1, 3 * (1 - turn / ROUNDS))
                for k in p:
                    d = g[k] / max(1.0, norm)
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def all_logits(p: Params, names: list[str], ids: np.ndarray, mask: np.ndarray, chunk: int = 4096) -> np.ndarray:
    terms = [np.concatenate(x) for x in zip(*(word_inputs(p, names[i : i + 20_000])[0] for i in range(0, max(1, len(names)), 20_000)))] if names else word_inputs(p, [""])[0]
    return np.concatenate([window_logits(p, terms, ids[i : i + chunk], mask[i : i + chunk])[0] for i in range(0, len(ids), chunk)])


class Scorer:
    """Scores texts; keeps the input terms of tokens it has seen."""

    class _Ids(dict):
        def __missing__(self, word: str) -> int:
            self[word] = place = len(self)
            return place

    def __init__(self, p: Params):
        self.p = p
        self._forget()

    def _forget(self) -> None:
        self.ids, self.done = self._Ids(), 0
        self.terms = [np.zeros((KEPT_WORDS, 3 * STATE), np.float32) for _ in "fb"]

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.ids) > KEPT_WORDS // 2:
            self._forget()
        look = self.ids.__getitem__
        parts = []
        for t in texts:
            found = tokens(t)
            parts.append(np.fromiter(map(look, found), np.int32, len(found)))
        names = list(self.ids)[self.done :]
        if len(self.ids) > len(self.terms[0]):
            more = len(self.ids) - len(self.terms[0])
            self.terms = [np.concatenate([t, np.zeros((more, 3 * STATE), np.float32)]) for t in self.terms]
        names.sort(key=len)  # little padding
        for i in range(0, len(names), 20_000):
            chosen = names[i : i + 20_000]
            at = np.fromiter(map(look, chosen), np.int64, len(chosen))
            for mine, new in zip(self.terms, word_inputs(self.p, chosen)[0]):
                mine[at] = new
        self.done = len(self.ids)
        flat = np.concatenate([*parts, np.zeros(1, np.int32)])
        place, mask, text = windows(np.array([len(x) for x in parts]))
        best = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(place), 4096):
            logit, _ = window_logits(self.p, self.terms, flat[place[i : i + 4096]], mask[i : i + 4096])
            np.maximum.at(best, text[i : i + 4096], logit)
        return sigmoid(best.astype(np.float64))


def held_out(key: str, folds: int, fold: int = 0):
    """crc32 of the key as text falls into the fold; a null key does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Params:
    """Fit on at most `rows` labelled texts outside the held-out fold: the first by hash of each label.

    Labels that are null or neither 0 nor 1 teach nothing; a key with both labels counts as 1;
    of a key's several texts each teaches.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key is not null and _label in (0, 1)")
    known = known.where(~held_out("_key", 5)).groupBy("_key").agg(F.max("_label").alias("_label"))
    half = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_key"), "_key").limit(rows // 2) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") <= TRAIN_CHARS)
    sample = texts.join(F.broadcast(half[0].unionByName(half[1])), "_key").dropDuplicates(["_key", "_text"])
    found = sorted((str(r["_key"]), r["_text"], int(r["_label"])) for r in sample.limit(4 * rows).collect())
    return train([r[1] for r in found], np.array([r[2] for r in found], np.int64))


def score_texts(docs: DataFrame, params: Params, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, held_out, score (0 to 1) and predicted (1 from 0.5 on), one row per row of docs.

    Null and empty texts get the score of a text without tokens. Repeated rows
    are scored each; other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(params)
        for batch, texts in text_batches(batches, "_text"):
            found = scorer.score([t.decode("utf-8", "replace") if t else "" for t in texts])
            yield columns(batch, ["_key"], {"score": pa.array(found, pa.float64())})

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["_key"], T.StructField("score", T.DoubleType(), False)]))
    return scored.select(F.col("_key").alias(key), held_out("_key", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
