"""Language-model scores of whole texts by a hidden Markov model over words.

Words of the training texts are counted over all of them. A state emits one of a
fixed number of word classes: the most frequent words are classes of their own,
the rest is hashed into classes, unknown words are one. Within its class a word
has its share of the add-one unigram. So P(word | state) sums to 1 over all
known words and one unknown. Words in classes find the states; then one more round
counts every word in every state, and scores use emissions of each word's own.

No task holds the vocabulary. Tasks number the words of a chunk of texts; the
counts are joined to each chunk's own list of words, which then meets the
chunk's texts again. Baum-Welch counts of all training texts are summed across
partitions; the scaled forward recursion gives a text's exact likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, stored, text_batches, words
from .toxicity import held_out

STATES = 6
FREQUENT = 2047  # words that are a class of their own
HASHED = 2048  # classes of the other known words
CLASSES = FREQUENT + HASHED + 1  # the last is that of unknown words
UNKNOWN = CLASSES - 1
CHUNK_TOKENS = 2_000_000
END = b" "  # stands for the end of a text; no word holds a space
ROUNDS = 23  # Baum-Welch rounds, each over all training texts
PIECE = 500_000  # tokens that training holds at once
RESCALE = 4  # steps from one scaling to the next
PRIOR = 1000.0  # weight of the unigram in a state's emissions
UNIT = 1 << 20  # expected counts are summed as whole numbers of this part, so that sums do not depend on the order
SLICE = 512
TURNS = 3  # parts of the chunks that are scored one after the other, which bounds the disk of their shuffles
STRENGTH = 10.0  # tokens that a class's share of the states counts for among those of a word


@dataclass
class Model:
    start: np.ndarray  # of a text's first state
    mean: np.ndarray  # of any state: its share of all tokens
    move: np.ndarray
    emit: np.ndarray  # states x classes


def _chunks(rows: DataFrame) -> DataFrame:
    """Texts as numbers of their chunk's words, and those words with their training counts; a row is either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        places: dict[bytes, int] = {END: 0}
        keys, held, ids, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.zeros(len(places), np.int64)
            for h, i in zip(held, ids):
                if not h:
                    counts += np.bincount(i, minlength=len(places)) if len(i) > len(places) // 16 else 0
                    if len(i) <= len(places) // 16:
                        np.add.at(counts, i, 1)
            n, m = len(ids), len(places)
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array(np.full(n + m, part * (1 << 32) + serial, np.int64)),
                "_key": pa.concat_arrays([*keys, pa.nulls(m, keys[0].type)]),
                "held": pa.array(held + [None] * m, pa.bool_()),
                "ids": pa.array([i.tobytes() for i in ids] + [None] * m, pa.binary()),
                "place": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
                "word": pa.array([None] * n + list(places), pa.binary()),
                "c": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(counts)]),
            })

        for batch, texts in text_batches(batches, "_text"):
            keys.append(batch.column(batch.schema.get_field_index("_key")))
            held += batch.column(batch.schema.get_field_index("held")).to_pylist()
            for t in texts:
                found = words(t)
                for w in set(found):
                    if w not in places:
                        places[w] = len(places)
                ids.append(np.fromiter(map(places.__getitem__, [*found, END]), np.int32, len(found) + 1))
                size += len(found) + 1
            if size >= CHUNK_TOKENS:
                yield flush()
                serial, places, keys, held, ids, size = serial + 1, {END: 0}, [], [], [], 0
        if ids:
            yield flush()

    head = T.StructType([T.StructField("chunk", T.LongType()), rows.schema["_key"]])
    return rows.mapInArrow(run, T.StructType(head.fields + T.StructType.fromDDL("held boolean, ids binary, place int, word binary, c bigint").fields))


def _coded(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Per text its packed class codes."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        _, found, _, _, kind = _of_chunk(texts, known)  # batches of like lengths take fewer steps
        codes = kind.astype(np.uint16)
        return pa.table({"codes": pa.array([codes[i].tobytes() for i in found], pa.binary())})

    return texts.groupBy("chunk").cogroup(places.groupBy("of")).applyInArrow(run, "codes binary")


def _columns(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, by time, and how many are still running at each time."""
    lengths = np.array([len(s) for s in sequences])
    running = (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(1) if len(lengths) * lengths[0] < 1 << 24 else len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(sequences)
    return np.concatenate([flat[starts[:n] + t] for t, n in enumerate(running)]), running


def log_likelihoods(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence of classes, by the scaled forward recursion."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    flat, running = _columns([codes[i] for i in order])
    emit, out = model.emit.T.copy(), np.zeros(len(codes))
    state, at = np.tile(model.start, (len(codes), 1)), 0
    for t, n in enumerate(running):
        state = (state[:n] @ model.move if t else state[:n]) * emit[flat[at : at + n]]
        scale = state.sum(1)
        state /= scale[:, None]
        out[:n] += np.log10(scale)
        at += n
    result = np.empty(len(codes))
    result[order] = out
    return result


def _cuts(ends: np.ndarray) -> list[tuple[int, int]]:
    """Times cut into runs of some PIECE tokens."""
    out, at = [], 0
    while at < len(ends):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right"))
        out.append((at, max(at + 1, to)))
        at = out[-1][1]
    return out


def expected_counts(model: Model, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, states, moves and emissions of whole texts.

    Emissions are taken relative to a class's mean over the states, so rows need a new scale only now and then. Any
    scale of a row will do: it falls out of the state probabilities. Longer input than PIECE tokens is run through in
    pieces of time, first to keep the state where each begins, then from the last piece back.
    """
    flat, running = _columns(sorted(codes, key=lambda c: -len(c)))
    emit = model.emit.T / np.maximum(model.emit.mean(0), 1e-300)[:, None]
    emit, move, begin = emit.astype(np.float32), model.move.astype(np.float32), np.append(0, np.cumsum(running))
    size, cuts, turned = running.tolist(), _cuts(begin[1:]), np.ascontiguousarray(move.T)
    ones = np.ones((STATES, STATES), np.float32)  # a row times these is its sum, once for each state

    def forward(first: int, last: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = begin[first]
        likely = emit[flat[base : begin[last]]]
        out, at = np.empty_like(likely), 0
        for t in range(first, last):
            n = size[t]
            row, to = out[at : at + n], at + n
            if t:
                np.dot(state[:n], move, out=row)
                row *= likely[at:to]
            else:
                np.multiply(state, likely[at:to], out=row)
            at = to
            if not t % RESCALE:
                row /= row @ ones
            state = row
        return likely, out

    entry = [model.start.astype(np.float32)]
    for first, last in cuts[:-1]:
        entry.append(forward(first, last, entry[-1])[1][-running[last - 1] :].copy())
    starts, states = np.zeros(STATES), np.zeros(STATES)
    kinds = model.emit.shape[1]
    moves, emits = np.zeros((STATES, STATES)), np.zeros((STATES, kinds))
    ahead = np.empty((0, STATES), np.float32)  # emission and all that follows, of the next time
    for (first, last), state in zip(reversed(cuts), reversed(entry)):
        likely, alpha = forward(first, last, state)
        base, beta = begin[first], np.ones_like(alpha)
        after, to, m = ahead, len(beta), len(ahead)
        for t in range(last - 1, first - 1, -1):
            n = size[t]
            at = to - n
            if m:
                np.dot(ahead, turned, out=beta[at : at + m])
            ahead = likely[at:to]  # of no other use from here
            ahead *= beta[at:to]
            to, m = at, n
            if not t % RESCALE:
                ahead /= ahead @ ones
        beta *= alpha
        whole = beta @ ones
        alpha /= whole
        beta /= whole  # now the state probabilities
        earlier = np.arange(running[first], len(alpha)) - np.repeat(running[first : last - 1], running[first + 1 : last])
        for i in range(0, len(earlier), 1 << 16):
            moves += alpha[earlier[i : i + (1 << 16)]].T @ likely[running[first] + i : running[first] + i + (1 << 16)][: len(earlier) - i]
        moves += alpha[begin[last - 1] - base :][: len(after)].T @ after
        if not first:
            starts += beta[: running[0]].sum(0, dtype=np.float64)
        states += beta.sum(0, dtype=np.float64)
        here = flat[base : begin[last]]
        emits += np.stack([np.bincount(here, beta[:, k], kinds) for k in range(STATES)])
    return starts, states, moves * model.move, emits


def improved(counts: tuple[np.ndarray, ...], mass: np.ndarray) -> Model:
    """The model that expected counts give, with a little of the unigram in every state."""
    start, mean, move, emit = counts
    start, mean, move, emit = start + 1, mean + 1, move + 0.1, emit + PRIOR * mass
    emit[:, -1] = 0  # no training text holds unknown words: every state gives them the unigram's share
    emit *= (1 - mass[-1]) / np.maximum(emit.sum(1, keepdims=True), 1e-300)
    emit[:, -1] = mass[-1]
    return Model(start / start.sum(), mean / mean.sum(), move / move.sum(1, keepdims=True), emit)


def start_model(mass: np.ndarray, seed: int = 11) -> Model:
    """Start values: states that differ at random and seldom change."""
    rng = np.random.default_rng(seed)
    emit = mass * rng.gamma(2.0, 0.5, (STATES, CLASSES))
    move = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
    np.fill_diagonal(move, 0.95)
    even = np.full(STATES, 1 / STATES)
    emit[:, -1] = mass[-1]
    emit[:, :-1] *= (1 - mass[-1]) / np.maximum(emit[:, :-1].sum(1, keepdims=True), 1e-300)
    return Model(even, even, move, emit)


def _batches(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches cut so that one holds about so many tokens."""
    for batch in batches:
        packed = batch.column(batch.schema.get_field_index("codes")).to_pylist()
        start, size = 0, 0
        for row, b in enumerate([*packed, None]):
            if row > start and (b is None or size + len(b) // 2 > tokens):
                yield batch.slice(start, row - start), [np.frombuffer(x, np.uint16).astype(np.int64) for x in packed[start:row]]
                start, size = row, 0
            size += len(b or b"") // 2


def _round(coded: DataFrame, model: Model, mass: np.ndarray) -> Model:
    """One Baum-Welch round over all training texts; tasks give sums of expected counts, Spark adds them up by place."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, codes in _batches(batches, PIECE):
            found = np.concatenate([x.ravel() for x in expected_counts(shared.value, codes)])
            total = found if total is None else total + found
        if total is not None:
            whole = np.zeros(-(-len(total) // SLICE) * SLICE, np.int64)
            whole[: len(total)] = np.rint(total * UNIT).astype(np.int64)
            offsets = pa.array(np.arange(0, len(whole) + 1, SLICE, dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(len(whole) // SLICE, dtype=np.int32)), "counts": pa.ListArray.from_arrays(offsets, pa.array(whole))})

    parts = coded.mapInArrow(run, "slice int, counts array<bigint>")
    sums = parts.select("slice", F.posexplode("counts").alias("place", "c")).groupBy("slice", "place").agg(F.sum("c").alias("c")).toPandas()
    size = STATES * (2 + STATES + CLASSES)
    total = np.zeros(-(-size // SLICE) * SLICE)
    total[(sums["slice"] * SLICE + sums["place"]).to_numpy(np.int64)] = sums["c"].to_numpy(np.float64) / UNIT
    start, mean, move, emit = np.split(total[:size], np.cumsum([STATES, STATES, STATES * STATES]))
    return improved((start, mean, move.reshape(STATES, STATES), emit.reshape(STATES, CLASSES)), mass)


def _of_chunk(texts: pa.Table, known: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's texts by length, their words' places, and by place the rows of known, counts and classes."""
    row = np.empty(known.num_rows, np.int64)
    row[known.column("place").to_numpy()] = np.arange(known.num_rows)
    c, kind = np.divmod(known.column("packed").to_numpy()[row], CLASSES)
    texts = texts.take(pc.sort_indices(pc.binary_length(texts.column("ids"))))
    return texts, [np.frombuffer(b, np.int32) for b in texts.column("ids").to_pylist()], row, c, kind


def _runs(sequences: list[np.ndarray], tokens: int) -> Iterator[tuple[int, int]]:
    """Runs of sequences that hold about so many tokens."""
    start, size = 0, 0
    for i, s in enumerate(sequences):
        if i > start and size + len(s) > tokens:
            yield start, i
            start, size = i, 0
        size += len(s)
    if sequences:
        yield start, len(sequences)


def _word_states(texts: DataFrame, places: DataFrame, model: Model) -> DataFrame:
    """Expected counts of each known word in each state, over all training texts: word, e0, e1 ... as whole numbers of 1 / UNIT."""
    names = [f"e{k}" for k in range(STATES)]

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts, found, row, c, kind = _of_chunk(texts, known)
        total, own = np.zeros((STATES, len(kind))), Model(model.start, model.mean, model.move, model.emit[:, kind])
        for first, last in _runs(found, PIECE):
            total += expected_counts(own, found[first:last])[3]
        seen = np.flatnonzero(total.sum(0)) if found else np.zeros(0, np.int64)
        whole = np.rint(total[:, seen] * UNIT).astype(np.int64)
        return pa.table({"word": known.column("word").take(pa.array(row[seen])), **{n: pa.array(x) for n, x in zip(names, whole)}})

    schema = "word binary, " + ", ".join(f"{n} bigint" for n in names)
    counts = texts.where("not held").groupBy("chunk").cogroup(places.groupBy("of")).applyInArrow(run, schema)
    return counts.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def _word_weights(counts: DataFrame, model: Model) -> DataFrame:
    """Each known word's add-one count dealt to the states as its own tokens lie there, few of them more as those of its class: word, packed, w."""
    of_class = model.mean[:, None] * model.emit
    of_class = of_class / np.maximum(of_class.sum(0), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, kind = np.divmod(batch.column("packed").to_numpy(), CLASSES)
            own = np.stack([batch.column(f"e{k}").to_numpy() for k in range(STATES)]) / UNIT
            share = own + STRENGTH * of_class[:, kind]
            share *= (c + 1) / share.sum(0)
            ends = pa.array(np.arange(0, share.size + 1, STATES, dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "packed": batch.column("packed"), "w": pa.ListArray.from_arrays(ends, pa.array(share.T.ravel().astype(np.float32)))})

    return counts.mapInArrow(run, "word binary, packed bigint, w array<float>")


def _scored(texts: DataFrame, places: DataFrame, model: Model, sums: np.ndarray, total: int, kinds: int) -> DataFrame:
    """Per text: _key, held, n_tokens, n_known, base_score, score, each word with emissions of its own."""
    whole = total + kinds + 1

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts, found, row, c, _ = _of_chunk(texts, known)
        seen, share = c > 0, np.log10((c + 1) / whole)
        emit = np.full((STATES, len(c)), 1 / whole)  # of words that no training text holds
        weights = known.column("w").combine_chunks().take(pa.array(row[seen])).flatten().to_numpy(zero_copy_only=False)
        emit[:, seen] = weights.reshape(-1, STATES).T * ((1 - 1 / whole) / sums)[:, None]
        own, log = Model(model.start, model.mean, model.move, emit), np.zeros(len(found))
        for first, last in _runs(found, CHUNK_TOKENS):
            log[first:last] = log_likelihoods(own, found[first:last])
        return pa.table({
            "_key": texts.column("_key"), "held": texts.column("held"), "n_tokens": pa.array([len(i) for i in found], pa.int64()),
            "n_known": pa.array([int(seen[i].sum()) for i in found], pa.int64()), "base_score": pa.array([float(share[i].sum()) for i in found], pa.float64()),
            "score": pa.array(log),
        })

    schema = T.StructType([texts.schema["_key"], *T.StructType.fromDDL("held boolean, n_tokens bigint, n_known bigint, base_score double, score double").fields])
    return texts.groupBy("chunk").cogroup(places.groupBy("of")).applyInArrow(run, schema)


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities: base_score of the add-one unigram, score of the
    hidden Markov model. A null text counts as empty: one token, its end. Rows
    without a key are learned from. Repeated rows count and are scored each; other
    columns are left out, whatever their names. Without training texts every word is unknown.
    """
    rows = docs.select(F.col(key).alias("_key"), held_out(key, 7, 2).alias("held"), F.col(text).cast("string").alias("_text"))
    chunks = stored(_chunks(rows))
    listed = chunks.where("place is not null").select("chunk", "place", "word", "c")
    counted = stored(listed.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"))
    frequent = counted.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    top = docs.sparkSession.createDataFrame([(bytes(r.word), i) for i, r in enumerate(frequent)], "word binary, own int")
    hashed = (F.lit(FREQUENT) + F.pmod(F.xxhash64("word"), F.lit(HASHED))).cast("int")
    classed = counted.join(F.broadcast(top), "word", "left").select("word", "c", F.coalesce("own", hashed).alias("class"))
    by_class = classed.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect()
    total, kinds = sum(r.c for r in by_class), sum(r.kinds for r in by_class)
    mass = np.zeros(CLASSES)
    for r in by_class:
        mass[r["class"]] = (r.c + r.kinds) / (total + kinds + 1)
    mass[UNKNOWN] = 1 / (total + kinds + 1)

    packed = F.coalesce("c", F.lit(0)) * CLASSES + F.coalesce("class", F.lit(UNKNOWN))  # count and class in one number
    here = listed.select(F.col("chunk").alias("of"), "place", "word")
    places = here.join(classed, "word", "left").select("of", "place", "word", packed.alias("packed"))
    texts = chunks.where("place is null").select("chunk", "_key", "held", "ids")
    coded = stored(_coded(texts.where("not held"), places.drop("word")))

    model = start_model(mass)
    for _ in range(ROUNDS if total else 0):
        model = _round(coded, model, mass)
    dropped(coded)

    found = classed.join(_word_states(texts, places, model), "word").withColumn("packed", F.col("c") * CLASSES + F.col("class"))
    weights = stored(_word_weights(found, model))
    sums = weights.agg(*[F.sum(F.col("w")[k].cast("double")).alias(f"w{k}") for k in range(STATES)]).first()
    sums = np.array([w or 1.0 for w in sums])
    places = here.join(weights, "word", "left").select("of", "place", F.coalesce("packed", F.lit(UNKNOWN)).alias("packed"), "w")
    turn = lambda chunk, i: F.pmod(F.xxhash64(chunk), F.lit(TURNS)) == i
    scored = [stored(_scored(texts.where(turn("chunk", i)), places.where(turn("of", i)), model, sums, total, kinds)) for i in range(TURNS)]
    dropped(chunks, counted, weights)
    return reduce(DataFrame.unionByName, scored).select(F.col("_key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score")
