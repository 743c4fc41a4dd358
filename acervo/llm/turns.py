"""Conversation structure repair by secondary-sorted streaming.

Faults of single rows are marked by column functions. Conversations then meet one
task each, sorted by turn from the last to the first, and stream through it in Arrow
batches. The state is the least cost, from each of four grammar states, to finish
the conversation; every row adds one byte, the best edit from each state. At the first turn
these bytes are followed in the conversation's own order, which gives the edits. As costs are known
from the end, equal ones are settled by the next letter alone, so the ASCII-least audit is exact.

Texts and bytes of a conversation beyond SPILL_BYTES wait in a temporary file of the
task, which a rerun writes anew, so memory stays bounded however long a conversation is.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPILL_BYTES = 32 << 20
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
ORDER = "DIKR"  # edits by their letters; a backpointer names each by its place here
START, SYSTEM, USER, ASSISTANT = range(4)  # what the output ends with
#: The grammar (s?(ua)+)?: where a role's initial leads from each state; None where it may not stand.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
GIVEN = (USER, USER, ASSISTANT, USER)  # the one state that a chosen role leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of finishing without further rows: nothing, user and assistant, assistant, nothing.
END = (0, 2 * INSERT_COST, INSERT_COST, 0)
GONE, SOUND, BLANK, DUPLICATE, TRUNCATED = range(5)  # a row that was dropped, and the faults


def step(costs: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs from the four states before a row, given those after it, and its byte of best edits, two bits for each state."""
    doomed = fault in (BLANK, DUPLICATE)
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    best: list[tuple[int, int]] = []
    for state in range(4):
        options = [(DELETE_COST + costs[state], ORDER.index(DELETE))]
        if not doomed:
            options.append((REROLE_COST + extra + costs[GIVEN[state]], ORDER.index(REROLE)))
            kept = NEXT.get(initial, (None,) * 4)[state]
            if kept is not None:
                options.append((extra + costs[kept], ORDER.index(KEEP)))
        best.append(min(options))
    for _ in range(4):  # an insertion leads on before the same row; costs above 0 settle at once
        best = [min(best[s], (INSERT_COST + best[GIVEN[s]][0], ORDER.index(INSERT))) for s in range(4)]
    return tuple(b[0] for b in best), sum(b[1] << 2 * s for s, b in enumerate(best))


class Steps:
    """step() with costs taken relative to the least one: few differences occur, so each is worked out once."""

    def __init__(self):
        self.known: dict[tuple, tuple[tuple[int, ...], int, int]] = {}

    def __call__(self, costs: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
        key = (costs, initial if initial in NEXT else "", fault)
        if (found := self.known.get(key)) is None:
            new, byte = step(costs, initial, fault)
            least = min(new)
            found = self.known[key] = (tuple(c - least for c in new), least, byte)
        return found


class Conversation:
    """One conversation while its rows stream by, from the last to the first."""

    def __init__(self, conv_id: object, steps: Steps):
        self.conv_id, self.steps = conv_id, steps
        self.costs, self.base = END, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = None
        self.after: str | None = None  # the role of the row that follows
        self.rows: list[tuple[str, str]] = []
        self.bytes = bytearray()
        self.held = 0
        self.spilled: list[tuple[int, int]] = []  # place and length of each part in the file
        self.file = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault == GONE:
            return
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high = turn, turn if self.high is None else self.high
            self.last_turn = turn
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        initial = role[:1]
        if self.after is not None:
            self.illegal += initial + self.after not in ("su", "ua", "au")
        self.after = initial
        self.costs, least, byte = self.steps(self.costs, initial, fault)
        self.base += least
        self.bytes.append(byte)
        self.rows.append((role, text))
        self.held += len(role) + len(text) + 100
        if self.held > SPILL_BYTES:
            self.spill()

    def spill(self) -> None:
        """Write the rows at hand and their backpointers to the task's file."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        data = pickle.dumps((bytes(self.bytes), self.rows), protocol=5)
        self.spilled.append((self.file.seek(0, 2), len(data)))
        self.file.write(data)
        self.rows, self.bytes, self.held = [], bytearray(), 0

    def forward(self) -> Iterator[tuple[int, str, str]]:
        """Backpointers and rows from the first turn on."""
        yield from ((b, *row) for b, row in zip(reversed(self.bytes), reversed(self.rows), strict=True))
        for place, length in reversed(self.spilled):
            self.file.seek(place)
            packed, rows = pickle.loads(self.file.read(length))  # the task's own file
            yield from ((b, *row) for b, row in zip(reversed(packed), reversed(rows), strict=True))

    def finish(self) -> tuple:
        state, audit, digest, first = START, [], hashlib.sha256(), True

        def put(role: str, text: str) -> None:
            nonlocal first
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            first = False

        for byte, role, text in self.forward():
            while (edit := ORDER[byte >> 2 * state & 3]) == INSERT:
                audit.append(edit)
                state = GIVEN[state]
                put(ROLE[state], "")
            audit.append(edit)
            if edit == KEEP:
                state = NEXT[role[:1]][state]
                put(role, text)
            elif edit == REROLE:
                state = GIVEN[state]
                put(ROLE[state], text)
        while state in (SYSTEM, USER):
            audit.append(INSERT)
            state = GIVEN[state]
            put(ROLE[state], "")
        if self.file is not None:
            self.file.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.base + self.costs[START], "".join(audit), digest.hexdigest())


def trimmed_end(text: Column) -> Column:
    """A text without spaces at its end: the six ASCII spaces."""
    return F.rtrim(text, F.lit(SPACES))


def mark_faults(rows: DataFrame) -> DataFrame:
    """Adds `fault` to rows (conv_id, turn, role, text, gone): the first fault of each, GONE where gone.

    Duplicate: role and text stood in an earlier row of the conversation, an earlier turn
    or a row of the same turn. Earliest turns are found by an aggregate of digests; only digests
    that several turns share return, joined by conversation and digest.
    """
    digests = rows.withColumn("_a", F.xxhash64("role", "text")).withColumn("_b", F.xxhash64(F.lit(7), "text", "role"))
    present = digests.where(~F.col("gone"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # null turns come first
    earliest = present.groupBy("conv_id", "_a", "_b").agg(F.min(when).alias("_first"), F.max(when).alias("_last")).where("_first < _last").drop("_last")
    earliest = earliest.select(F.col("conv_id").alias("_c"), F.col("_a").alias("_x"), F.col("_b").alias("_y"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))
    joined = digests.join(earliest, same, "left")
    last = F.substring(trimmed_end(F.col("text")), -1, 1)
    repeated = F.coalesce(F.col("_first") < when, F.lit(False))
    fault = (
        F.when(F.col("gone"), GONE)
        .when(last == "", BLANK)
        .when(repeated, DUPLICATE)
        .when(last.isin(*ENDS), SOUND)
        .otherwise(TRUNCATED)
    )
    return joined.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """Counts, least cost, audit and digest of each conversation in rows (conv_id, turn, role, text, gone).

    Returned: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation stand by turn (nulls first), those of one turn by role and text;
    further copies within a turn are duplicates. Role and text are not null (see damaged());
    a null conv_id is a conversation of its own. A conversation whose rows are all gone has
    zeros, an empty audit and the digest of an empty string. Other columns are left out. An empty table gives an empty one.
    A very long conversation is streamed by one task, with its texts and backpointers in a file.
    """
    marked = mark_faults(rows)
    backwards = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    met = marked.repartition("conv_id").sortWithinPartitions("conv_id", *backwards)
    whole = met.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "fault")  # pandas has no exact whole numbers beside nulls
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType(
        [T.StructField("conv_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )
    found = whole.mapInPandas(_streamed([f.name for f in schema.fields]), schema)
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def _streamed(names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, open_one, pending = Steps(), None, None
        done: list[tuple] = []
        size = 0

        def settle(earlier: tuple | None) -> None:
            """A row is a duplicate if the row before it in the conversation has the same turn, role and text."""
            nonlocal pending
            if pending is not None:
                turn, role, text, fault = pending
                if earlier is not None and fault in (SOUND, TRUNCATED) and earlier[3] != GONE and earlier[:3] == (turn, role, text):
                    fault = DUPLICATE
                open_one.add(turn, role, text, fault)
            pending = earlier

        for frame in batches:
            for conv_id, turn, role, text, fault in zip(*(frame[c] for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if open_one is None or conv_id != open_one.conv_id:
                    if open_one is not None:
                        settle(None)
                        done.append(open_one.finish())
                        size += len(done[-1][7]) + 200
                    open_one = Conversation(conv_id, steps)
                settle((None if turn is None else int(turn), role, text, fault))
            if size > 4 << 20 or len(done) > 5000:
                yield pd.DataFrame(done, columns=names)
                done, size = [], 0
        if open_one is not None:
            settle(None)
            done.append(open_one.finish())
        if done:
            yield pd.DataFrame(done, columns=names)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after a repeatable damage, with `gone` for those it drops.

    crc32("conv_id:turn") % 20 decides: 0 drops the row, 1 empties its text, 2 removes
    [.!?] from it, 3 repeats it, 4 sets the role user. Nulls count as one space, in that key and as role or text.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("_kind"))
    hit = F.col("_kind")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(hit == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("gone"), copies.alias("_copy")).drop("_copy")
