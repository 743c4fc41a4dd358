"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class. In each pass classes are ordered by
label and by a code of concatenated random hyperplane signs, and every class is
compared with the WINDOW classes before it. Larger labels get more passes. Verified pairs of all passes are
united into components. Within a component all pairs are then compared, in
blocks, so that links a window was too small for are counted as well.

The order of a pass is a range partitioning; what stands at the borders of
partitions is compared in a second step, so that results do not depend on where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

PASSES, BITS, WINDOW = 16, 62, 32
FEW, GROWTH = 10_000, 0.2  # PASSES are enough for so many classes of a label; the chance of a pass to meet a pair falls with this power of their number
SEED = 20_201
BLOCK = 1024  # vectors of one side of a block within a component
CHUNK = 1024  # rows of a pass compared at once


def passes_for(classes: int) -> int:
    """Passes for a largest label of so many classes: PASSES * (classes / FEW) ** GROWTH, at least PASSES."""
    return max(PASSES, math.ceil(PASSES * (classes / FEW) ** GROWTH - 1e-9))


def _usable(vector: Column, label: Column) -> Column:
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & F.forall(numbers, finite) & F.exists(numbers, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.stack([np.frombuffer(b, np.float64) for b in column.to_pylist()]) if len(column) else np.empty((0, 0))


def _codes(x: np.ndarray, passes: int) -> np.ndarray:
    """Code of each row in each pass: BITS signs, the first weighs most."""
    rng = np.random.default_rng((SEED, x.shape[1]))
    planes = rng.normal(size=(x.shape[1], passes * BITS))
    signs = (x @ planes > 0).reshape(len(x), passes, BITS)
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as packed doubles, in place of the column vector; the length is scaled out first, so that no square overflows."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("vector")).to_pylist()
        out = []
        for v in lists:
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            out.append((x / np.sqrt(x @ x)).tobytes())
        place = batch.schema.get_field_index("vector")
        yield batch.set_column(place, "vector", pa.array(out, pa.binary()))


def _pass_rows(classes: DataFrame, passes: int) -> DataFrame:
    """Each class once for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                sizes = np.array([len(b) for b in batch.column(batch.schema.get_field_index("vector")).to_pylist()])
                for size in np.unique(sizes):
                    part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                    names = part.schema.names
                    codes = _codes(_matrix(part.column(names.index("vector"))), passes)
                    places = pa.array(np.tile(np.arange(part.num_rows), passes))
                    kept = {n: part.column(names.index(n)).take(places) for n in ("class", "label", "size", "tie", "vector")}
                    yield pa.RecordBatch.from_pydict({"turn": pa.array(np.repeat(np.arange(passes, dtype=np.int32), part.num_rows)), "code": pa.array(codes.T.ravel()), **kept})

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("class", "label", "size", "tie", "vector").mapInArrow(run, f"turn int, code bigint, class bigint, label {kind}, size int, tie bigint, vector binary")


def _near(before: pa.Table, after: pa.Table, gap: np.ndarray, least: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (of before, of after) whose places, gap, differ by 1 to window, in one pass, label and length."""
    found_a, found_b, numbers = [], [], {}
    runs = [np.array([numbers.setdefault(k, len(numbers)) for k in zip(*(t.column(c).to_pylist() for c in ("turn", "label", "size")))], int) for t in (before, after)]
    close = (gap > 0) & (gap <= window) & (runs[0][:, None] == runs[1][None, :])
    sizes = np.array(after.column("size").to_pylist())
    for size in np.unique(sizes):
        i = np.flatnonzero(np.array(before.column("size").to_pylist()) == size)
        j = np.flatnonzero(sizes == size)
        if len(i) and len(j):
            hit = close[np.ix_(i, j)] & (_matrix(before.column("vector").take(pa.array(i))) @ _matrix(after.column("vector").take(pa.array(j))).T >= least)
            a, b = np.nonzero(hit)
            found_a.append(i[a])
            found_b.append(j[b])
    empty = np.empty(0, np.int64)
    return np.concatenate(found_a or [empty]), np.concatenate(found_b or [empty])


def _links_in_passes(ordered: DataFrame, least: float, window: int) -> DataFrame:
    """Links (a, b) within partitions of the ordered passes; border rows with their partition, place from the start and from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        tail: pa.Table | None = None

        def rows(table: pa.Table, first: int, end: bool) -> pa.RecordBatch:
            n = table.num_rows
            at = np.arange(first, first + n, dtype=np.int64)
            data = {c: table.column(c).combine_chunks() for c in ("class", "turn", "label", "size", "vector")}
            return pa.RecordBatch.from_pydict({"a": pa.nulls(n, pa.int64()), "b": pa.nulls(n, pa.int64()), "part": pa.array(np.full(n, part, np.int32)), "at": pa.array(at), "ending": pa.array([end] * n), **data})

        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                new = pa.Table.from_batches([whole.slice(start, CHUNK)])
                if place < window:
                    yield rows(new.slice(0, window - place), place, False)
                both = pa.concat_tables([tail, new]) if tail is not None else new
                k = both.num_rows - new.num_rows
                gap = (k + np.arange(new.num_rows))[None, :] - np.arange(both.num_rows)[:, None]
                i, j = _near(both, new, gap, least, window)
                ids = both.column("class").to_numpy()
                n = len(i)
                none = {c: pa.nulls(n, both.schema.field(c).type) for c in ("class", "turn", "label", "size", "vector")}
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids[i]), "b": pa.array(ids[k + j]), "part": pa.nulls(n, pa.int32()), "at": pa.nulls(n, pa.int64()), "ending": pa.nulls(n, pa.bool_()), **none})
                tail = both.slice(max(0, both.num_rows - window))
                place += new.num_rows
        if tail is not None:
            yield rows(tail, place - tail.num_rows, True)

    kind = ordered.schema["label"].dataType.simpleString()
    return ordered.mapInArrow(run, f"a bigint, b bigint, part int, at bigint, ending boolean, class bigint, turn int, label {kind}, size int, vector binary")


def _links_at_borders(found: DataFrame, least: float, window: int) -> DataFrame:
    """Links between the first rows of each partition and the rows before them in earlier partitions."""
    counts = {r.part: r.n for r in found.where("ending").groupBy("part").agg((F.max("at") + 1).alias("n")).collect()}
    parts, table = sorted(counts), []
    for k, p in enumerate(parts):
        gap = 0
        for q in parts[k + 1 :]:
            if gap >= window:
                break
            table.append((p, q, counts[p], gap))
            gap += counts[q]
    spark = found.sparkSession
    near = spark.createDataFrame(table, "part int, target int, n long, gap long")
    rows = found.where("ending is not null")
    before = rows.where("ending").join(F.broadcast(near), "part").withColumn("at", F.col("at") - F.col("n") - F.col("gap")).where(F.col("at") >= -window)
    fields = ["target", "at", "class", "turn", "label", "size", "vector"]
    after = rows.where("not ending").withColumn("target", F.col("part"))

    def run(group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        early, late = group.filter(pa.array(at < 0)), group.filter(pa.array(at >= 0))
        gap = at[at >= 0][None, :] - at[at < 0][:, None]
        i, j = _near(early, late, gap, least, window)
        return pa.table({"a": early.column("class").to_numpy()[i], "b": late.column("class").to_numpy()[j]})

    return before.select(fields).unionAll(after.select(fields)).groupBy("target").applyInArrow(run, "a bigint, b bigint")


def _link_counts(members: DataFrame, least: float) -> DataFrame:
    """(class, linked): rows that each class links with in its component, without its own copies.

    Small components share blocks; a large one is cut into blocks by hash, and each two of them meet once.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    total = sizes.agg(F.sum("m").alias("m")).first().m or 0
    bins = max(1, total // BLOCK)
    cut = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    small = F.col("blocks") == 1
    cut = cut.withColumn("bin", F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")))
    cut = cut.withColumn("own", F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("bin", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "class", "copies", "vector")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own = group.column("own").to_numpy()
        sides = [group.filter(pa.array(own == s)) for s in ((i, j) if i != j else (i,))]
        left, right = sides[0], sides[-1]
        hit = np.zeros((left.num_rows, right.num_rows), bool)
        comp = [s.column("component").to_numpy() for s in (left, right)]
        lengths = [np.array([len(b) for b in s.column("vector").to_pylist()]) for s in (left, right)]
        for size in np.unique(lengths[0]):
            a, b = np.flatnonzero(lengths[0] == size), np.flatnonzero(lengths[1] == size)
            if len(b):
                cosine = _matrix(left.column("vector").take(pa.array(a))) @ _matrix(right.column("vector").take(pa.array(b))).T
                hit[np.ix_(a, b)] = (cosine >= least) & (comp[0][a][:, None] == comp[1][b][None, :])
        if i == j:
            np.fill_diagonal(hit, False)
        counts = [(left, hit @ right.column("copies").to_numpy())] + ([(right, hit.T @ left.column("copies").to_numpy())] if i != j else [])
        return pa.table({"class": np.concatenate([s.column("class").to_numpy() for s, _ in counts]), "linked": np.concatenate([n for _, n in counts]).astype(np.int64)})

    parts = cut.groupBy("bin", "i", "j").applyInArrow(run, "class bigint, linked bigint")
    return parts.groupBy("class").agg(F.sum("linked").alias("linked"))


def near_vectors(vectors: DataFrame, least: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id", passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """One row per row: key, n_links (other rows linked directly), component_id (smallest key reachable), kept (key = component_id).

    Rows link when their labels are equal and their cosine, in double precision, is at least
    `least`. Rows whose label or vector is null, whose vector is empty, zero or holds a null or
    a number that is not finite, and vectors of different length, do not link. Repeated rows are vectors of
    their own. Null keys take part; no component is named after them unless it has no
    other, and kept is false for them. Other columns are left out, whatever their names.
    Without `passes`, their number grows with the largest label, see passes_for.
    """
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("label"), F.col(vector).alias("vector")).withColumn("fits", _usable(F.col("vector"), F.col("label")))
    folded = rows.where("fits").groupBy("label", "vector").agg(F.min("_key").alias("low"), F.count("*").alias("copies"))
    folded = stored(folded.withColumns({"class": F.monotonically_increasing_id(), "tie": F.xxhash64("vector"), "size": F.size("vector")}))
    kind = folded.schema["label"].dataType.simpleString()
    packed = folded.select("class", "label", "size", "tie", "copies", "vector").mapInArrow(_packed, f"class bigint, label {kind}, size int, tie bigint, copies bigint, vector binary")
    packed = stored(packed)

    width = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if passes is None:
        passes = passes_for(packed.groupBy("label", "size").count().agg(F.max("count").alias("n")).first().n or 0)
    order = ["turn", "label", "size", "code", "tie", "class"]
    ordered = _pass_rows(packed, passes).repartitionByRange(width, *order).sortWithinPartitions(*order)
    found = stored(_links_in_passes(ordered, least, window))
    links = found.where("a is not null").select("a", "b").unionAll(_links_at_borders(found, least, window))
    labels = stored(components(links))

    linked = _link_counts(packed.join(labels.withColumnRenamed("id", "class"), "class"), least)
    lows = labels.join(folded.select(F.col("class").alias("id"), "low"), "id").groupBy("component").agg(F.min("low").alias("least"))
    groups = labels.join(lows, "component").select(F.col("id").alias("class"), "component", "least")
    known = folded.join(groups, "class", "left").join(linked, "class", "left").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("least"))
    joined = rows.where("fits").join(known, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")))
    out = joined.select("_key", "n", "least").unionAll(rows.where("not fits").select("_key", F.lit(0).cast("long").alias("n"), F.col("_key").alias("least")))
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_links"), F.col("least").alias("component_id"), F.coalesce(F.col("_key") == F.col("least"), F.lit(False)).alias("kept"))
