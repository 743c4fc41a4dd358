"""Mixing sources to target weights by a Pfair schedule.

Each source's rows, in hashed order, are cut into blocks of equal text length.
With weight w, block i of a source may run from slot floor(i / w) on and must
have run by slot ceil((i + 1) / w); in every slot the released block with the
earliest deadline runs. With weights that sum to 1 no deadline is missed, so that
at any slot each source has run its weight's share but for less than one block.

Weights are whole shares of a period of slots, so the schedule repeats: it is
worked out for one period (a fixed number of slots) and joined to blocks by their
number modulo the source's share. Where a source has no blocks left its slots stay empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import covered

PERIOD = 10_000  # slots of the schedule that repeats; at most so many sources
BLOCK_CHARS = 1 << 15
EXPONENT = 0.7  # default weights: text length of the source to this power
BUCKET_ROWS = 2048  # rows that one window of running totals is meant to hold
FAN = 1 << 12  # buckets that one window of bucket totals holds


def whole_shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Positive whole shares that sum to the period: largest remainders, ties by name; each weight above 0 gets at least 1."""
    names = sorted(k for k, w in weights.items() if w > 0)
    if len(names) > period:
        raise ValueError(f"{len(names)} sources need a period of at least as many slots")
    total, spare = sum(weights[k] for k in names), period - len(names)
    exact = {k: weights[k] / total * period for k in names}
    shares = {k: max(1, int(exact[k])) for k in names}
    for k in sorted(names, key=lambda k: (int(exact[k]) - exact[k], k)):
        if sum(shares.values()) >= period:
            break
        shares[k] += 1
    while (over := sum(shares.values()) - period) > 0:  # many tiny weights were raised to 1
        k = max(names, key=lambda k: (shares[k], k))
        shares[k] -= min(over, shares[k] - 1, max(1, spare // 2))
    return shares


def schedule(shares: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period: the earliest deadline among released blocks, ties by name."""
    period = sum(shares.values())
    waiting = [(0, -(-period // c), k, 0) for k, c in shares.items()]
    heapq.heapify(waiting)
    ready, slots = [], []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, deadline, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, i))
        _, k, i = heapq.heappop(ready)
        slots.append(k)
        if i + 1 < shares[k]:
            heapq.heappush(waiting, ((i + 1) * period // shares[k], -(-(i + 2) * period // shares[k]), k, i + 1))
    return slots


def _name(source: Column) -> Column:
    """A source's name in the schedule; no source (null) is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def default_weights(docs: DataFrame, text: str = "text", source: str = "source", exponent: float = EXPONENT) -> dict[str | None, float]:
    """Text length of each source to the exponent (at least one character), for all sources that have rows."""
    found = docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.sum(F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0))).alias("n")).collect()
    return {r.s: float(max(1, r.n)) ** exponent for r in found}


def placed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, text: str = "text", source: str = "source", key: str = "doc_id",
           block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """All rows and columns of docs with _block, _release, _deadline, _slot and _offset (characters of the block before the row).

    The order (_slot, _offset) is the mix. No row is dropped: sources without a
    weight (or with 0) follow after all weighted ones, in slots that start behind the last period used. The five
    columns stand in place of any columns so named; other columns may have any names.
    """
    made = ("_block", "_release", "_deadline", "_slot", "_offset")
    own = [c for c in docs.columns if c not in made]
    plain, named = covered(docs.select(*(F.col(c) for c in own)))
    found = _places(plain, weights, named[text], named[source], named[key], block_chars, period)
    return found.select(*plain.columns, *made).toDF(*own, *made)


def _places(docs: DataFrame, weights: Mapping[str | None, float] | None, text: str, source: str, key: str, block_chars: int, period: int) -> DataFrame:
    rows = measured(docs, text, source, key)
    return _placed(rows, rows, default_weights(docs, text, source) if weights is None else weights, key, block_chars, period)


def measured(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """All rows and columns of docs with what their places depend on: _name (of the source), _chars and _hash."""
    return docs.withColumns({
        "_name": _name(F.col(source)), "_chars": F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).cast("long"),
        "_hash": F.xxhash64(F.col(key), F.col(text).cast("string")),
    })


def _placed(rows: DataFrame, light: DataFrame, weights: Mapping[str | None, float], key: str, block_chars: int, period: int) -> DataFrame:
    """placed() for measured rows; light holds the same rows, and is what totals are read from."""
    shares = whole_shares({"null" if k is None else f"={k}": w for k, w in weights.items()}, period)
    if not shares:
        shares = {"": period}
    seen: dict[str, int] = {}
    table = []
    for slot, k in enumerate(schedule(shares)):
        table.append((k, shares[k], seen.setdefault(k, 0), slot))
        seen[k] += 1
    spark = rows.sparkSession
    slots = spark.createDataFrame(table, "_name string, _share long, _nth long, _at long")
    n = light.count()
    bits = max(0, (max(1, n) // BUCKET_ROWS).bit_length())
    bucket = F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("_bucket", bucket)
    sizes = light.withColumn("_bucket", bucket).select("_name", "_bucket", "_chars").groupBy("_name", "_bucket").agg(F.sum("_chars").alias("c"))
    before = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_coarse", F.floor(F.col("_bucket") / FAN))
    coarse = sizes.groupBy("_name", "_coarse").agg(F.sum("c").alias("c"))
    coarse = coarse.select("_name", "_coarse", F.coalesce(F.sum("c").over(before.partitionBy("_name")), F.lit(0)).alias("_base"))
    fine = Window.partitionBy("_name", "_coarse").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(coarse, ["_name", "_coarse"]).select(
        F.col("_name").alias("_n"), F.col("_bucket").alias("_b"), (F.col("_base") + F.coalesce(F.sum("c").over(fine), F.lit(0))).alias("_base"))
    within = Window.partitionBy("_name", "_bucket").orderBy("_hash", key, "_chars").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_prior", F.coalesce(F.sum("_chars").over(within), F.lit(0)))
    rows = rows.join(starts, (F.col("_name") == F.col("_n")) & (F.col("_bucket") == F.col("_b")))
    rows = rows.withColumn("_prior", F.col("_prior") + F.col("_base")).withColumn("_block", F.floor(F.col("_prior") / block_chars))
    rows = rows.withColumn("_offset", F.col("_prior") - F.col("_block") * block_chars)

    share = slots.groupBy("_name").agg(F.first("_share").alias("_share"))
    rows = rows.join(F.broadcast(share), "_name", "left").withColumn("_nth", F.pmod("_block", "_share"))
    rows = rows.join(F.broadcast(slots.drop("_share")), ["_name", "_nth"], "left")
    turn = F.floor(F.col("_block") / F.col("_share"))
    last = _last_slot(sizes, share, block_chars, period)
    return rows.withColumns({
        "_release": F.floor(F.col("_block") * period / F.col("_share")),
        "_deadline": F.ceil((F.col("_block") + 1) * period / F.col("_share")),
        "_slot": F.coalesce(turn * period + F.col("_at"), F.lit(last) + F.col("_block")),
    }).drop("_name", "_chars", "_hash", "_bucket", "_prior", "_n", "_b", "_base", "_share", "_nth", "_at")


def _last_slot(sizes: DataFrame, share: DataFrame, block_chars: int, period: int) -> int:
    """The first slot behind every period that weighted sources use."""
    turns = sizes.groupBy("_name").agg(F.sum("c").alias("c")).join(F.broadcast(share), "_name")
    found = turns.agg(F.max(F.floor(F.col("c") / block_chars / F.col("_share")) + 1).alias("t")).first().t
    return int(found or 0) * period


def mix_plan(docs: DataFrame, weights: Mapping[str | None, float] | None = None, text: str = "text", source: str = "source", key: str = "doc_id",
             block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """One row per row of docs: key, source, n_chars, block, offset, release, deadline, slot; order by slot and offset to mix.

    Null and empty texts take no room in their block. A null source is a
    source of its own. Repeated rows are placed each. Sources without weight
    have neither release nor deadline and come last. Other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(text).cast("string").alias("_text"))
    rows = rows.select("*", F.coalesce(F.char_length("_text"), F.lit(0)).cast("long").alias("_length"))
    weights = default_weights(rows, "_text", "_source") if weights is None else weights
    light = _places(rows, weights, "_text", "_source", "_key", block_chars, period)
    return light.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_length").alias("n_chars"), F.col("_block").alias("block"),
                        F.col("_offset").alias("offset"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"))


def mixed_after(docs: DataFrame, work: Callable[[DataFrame, tuple[str, ...]], DataFrame], text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """What work makes of the rows, with slot and offset of mix_plan, sorted into the mix.

    work gets docs and the columns it has to keep, and gives one row per row; it runs once, ahead of every shuffle.
    Columns of docs that begin with an underscore have other names there; text, source and key do not.
    """
    plain, _ = covered(docs)
    rows = measured(plain, text, source, key)
    done = work(rows, (key, "_name", "_chars", "_hash"))
    placed_rows = _placed(done, rows, default_weights(plain, text, source), key, BLOCK_CHARS, PERIOD)
    placed_rows = placed_rows.withColumnsRenamed({"_slot": "slot", "_offset": "offset"}).drop("_block", "_release", "_deadline")
    return placed_rows.orderBy("slot", "offset", key)


def mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """All rows and columns of docs, sorted into the mix: written out, its files follow one another in mixed order.

    Options are those of placed(). Null and empty texts take no room, a null source is a source of its own, repeated
    rows are placed each, equal places follow in any order. Columns may have any names. An empty table gives an empty one.
    """
    plain, named = covered(docs)
    options |= {"text": named[options.get("text", "text")], "source": named[options.get("source", "source")], "key": named[options.get("key", "doc_id")]}
    rows = placed(plain, weights, **options)
    return rows.orderBy("_slot", "_offset").select(*plain.columns).toDF(*docs.columns)
