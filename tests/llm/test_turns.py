"""Conversation repair against a search over all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from acervo.llm import turns
from acervo.llm.queries import QUERIES

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) and its output, by trying all edits forward with the output's last role as state."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, a, o = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if role[:1] and role[:1] in follow[last]:
                    c, a, o = best(i + 1, role[:1], 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *o)))
                for r in "ua":
                    if r in follow[last]:
                        c, a, o = best(i + 1, r, 0)
                        options.append((c + extra + 3, "R" + a, (f"{full[r]}:{text}", *o)))
        if inserted < 4:
            for r in "ua":
                if r in follow[last]:
                    c, a, o = best(i, r, inserted + 1)
                    options.append((c + 3, "I" + a, (f"{full[r]}:", *o)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    """All rows (conv_id, turn, role, text) before damage."""
    out = []
    after = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(mine)
        cost, audit, output = cheapest(tuple(mine), tuple(faults))
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(output).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return sorted((tuple(r) for r in turns.repair(turns.damaged(spark.createDataFrame(rows, schema))).collect()), key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "User", "tool", "", None]
    texts = ["Yes.", "No!", "open end", " ", "", None, "a\nb?", "é.  \n", "x"]
    return [
        (rng.choice([None, *range(n // 6)]), rng.choice([None, *range(-3, 9)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choices(texts, [4, 4, 2, 1, 1, 1, 3, 3, 1])[0] if rng.random() < 0.6 else f"n {rng.random()}.")
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 600)
    assert repaired(spark, rows) == brute(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_turn_repair"](spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_audit_gives_the_grammar():
    for initials in itertools.product("suax", repeat=4):
        rows = tuple((1, i, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[c], f"t{i}.") for i, c in enumerate(initials))
        _, _, output = cheapest(rows, ("",) * 4)
        assert GRAMMAR.fullmatch("".join(o[0] for o in output))


def test_giant_conversation_spills(spark, monkeypatch):
    rng = random.Random(5)
    one = turns.Conversation(1, turns.Steps())
    two = turns.Conversation(1, turns.Steps())
    monkeypatch.setattr(turns, "SPILL_BYTES", 1 << 62)
    rows = [(t, rng.choice(["user", "assistant", "system"]), f"text {rng.random()}" + rng.choice([".", ""]) + "é" * 40, rng.choice([1, 1, 1, 2, 3, 4])) for t in range(9000, 0, -1)]
    for r in rows:
        one.add(*r)
    monkeypatch.setattr(turns, "SPILL_BYTES", 100_000)
    for r in rows:
        two.add(*r)
    assert two.spilled and not one.spilled
    assert len(two.rows) < 1000
    assert one.finish() == two.finish()


def test_long_conversation_over_many_batches(spark):
    rows = [(7, t, "user" if t % 2 else "assistant", f"line {t % 997}.") for t in range(25_000)]
    assert repaired(spark, rows)[0][:3] == brute_counts(rows)


def brute_counts(rows):
    mine = sorted(plain_damage(rows), key=lambda r: r[1])
    faults = faults_of(mine)
    known = {r[1] for r in mine}
    return 7, max(known) - min(known) + 1 - len(known), faults.count("blank")


def test_odd_tables(spark):
    big = 2**60 + 1  # beyond what a double holds
    rows = [(big, 1, "user", "Hi."), (big, 2, "assistant", "Yo."), (None, None, None, None), (None, big, "user", "x" * 300_000)]
    assert repaired(spark, rows) == brute(rows)
    wide = spark.createDataFrame([("c", 1, "user", "Hi.", "z", 1)], "conv_id string, turn int, role string, text string, fault string, _first int")
    assert turns.repair(turns.damaged(wide)).first().conv_id == "c"
    assert turns.repair(turns.damaged(wide.limit(0))).count() == 0


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(5, turn, "user", "Hi.")]) == [(5, 0, 0, 0, 0, 0, 0, "", nothing)]
