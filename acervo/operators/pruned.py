"""Exact best inner products and nearest points without scoring every pair.

Items are put into cells, each with what bounds the scores of all its items. For inner products
a cell holds items nearest to one of some seeded items (its centre), within a stretch of norms:
u.c + |u| r and |u| times the largest norm are bounds, with the radius r around the centre. For
distances a cell is a box, cut from quantiles axis by axis. Askers visit cells in the order
of their bounds, in waves of doubling size, and stop where the bound falls below the last score they need.

Only the table of cells, MAX_CELLS rows or little more, is broadcast. Askers of a cell are
split by a hash, so a cell that all of them want is many groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from acervo.functions.sampling import draw
from acervo.operators.tiles import dealt, distinct_rows, matrix, members, numbers, strips, top_per_row
from acervo.session import cut_lineage

CELL_ROWS = 20_000  # items of a cell, unless there would be more than MAX_CELLS
MAX_CELLS = 4096
CENTRES = 512  # at most; a cell is a stretch of norms around a centre
GROUP_ROWS = 20_000  # users of a group
VISIT_ROWS = 10_000  # rows of a batch of visits
SLACK = 1e-9  # bounds are widened by this share, as sums of products are rounded


@dataclass
class Cells:
    """Items with their cell, and what bounds the inner products in each cell."""

    items: DataFrame | None  # id, vetor and further columns, _cell
    centres: np.ndarray  # one row for each cell
    radius: np.ndarray
    norm: np.ndarray
    size: np.ndarray
    visited: list[int] = field(default_factory=list)  # pairs scored in each wave

    def bounds(self, users: np.ndarray) -> np.ndarray:
        """Upper bounds of the score of each user (row) in each cell (column)."""
        length = np.sqrt((users * users).sum(axis=1))[:, None]
        near = users @ self.centres.T
        wide = SLACK * (length * (np.sqrt((self.centres * self.centres).sum(axis=1)) + self.radius + self.norm)[None, :] + 1e-300)
        return np.minimum(near + length * self.radius[None, :], length * self.norm[None, :]) + wide


@dataclass
class Boxes:
    """Points with their box; the score is the negative squared distance."""

    items: DataFrame | None  # vetor and further columns, _cell
    low: np.ndarray  # one row for each box
    high: np.ndarray
    size: np.ndarray
    visited: list[int] = field(default_factory=list)

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """The negative squared distance of each point (row) to the nearest place of each box (column)."""
        away = np.zeros((len(points), len(self.size)))
        for axis in range(self.low.shape[1]):
            x = points[:, axis][:, None]
            gap = np.maximum(0.0, np.maximum(self.low[None, :, axis] - x, x - self.high[None, :, axis]))
            away += gap * gap
        return SLACK - away * (1 - SLACK)


def build_boxes(points: DataFrame, axes: tuple[str, ...], rows: int = CELL_ROWS) -> Boxes:
    """Boxes of points whose coordinates are the columns ``axes``: quantiles of the first, within each of its parts of the second, and so on."""
    n = points.count()
    parts = max(1, math.ceil(min(MAX_CELLS, math.ceil(n / rows)) ** (1 / len(axes)) - 1e-9))
    share = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    placed, path = points, []
    for axis in axes:
        part = f"_{axis}_part"
        if parts == 1:
            placed = placed.withColumn(part, F.lit(0))
        else:
            limits = placed.groupBy(*path).agg(F.percentile_approx(axis, share).alias("_cuts"))  # a row for each part so far
            placed = placed.join(F.broadcast(limits), path) if path else placed.join(F.broadcast(limits))
            placed = placed.withColumn(part, F.size(F.filter("_cuts", lambda c: c < F.col(axis)))).drop("_cuts")  # noqa: B023
        path.append(part)
    placed = cut_lineage(placed)
    ends = [f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]
    stats = placed.groupBy(*path).agg(*ends, F.count("*").alias("n")).orderBy(*path).collect()  # a row for each box
    number = points.sparkSession.createDataFrame([(*[r[p] for p in path], i) for i, r in enumerate(stats)], ", ".join(f"{p} int" for p in path) + ", _cell int")
    kept = placed.join(F.broadcast(number), path).drop(*path)
    edge = lambda name: np.array([[r[f"{name}_{a}"] for a in axes] for r in stats], np.float64).reshape(-1, len(axes))
    return Boxes(kept, edge("min"), edge("max"), np.array([r["n"] for r in stats], np.float64))


def build_cells(items: DataFrame, rows: int = CELL_ROWS, seed: int = 42) -> Cells:
    """Cells of items (unique ``id``, ``vetor``)."""
    n = items.count()
    rows = max(rows, math.ceil(2 * n / MAX_CELLS))
    some = max(1, min(CENTRES, math.ceil(n / rows)))
    # at most CENTRES vectors come to the driver
    centres = np.array([r["vetor"] for r in items.orderBy(draw(F.col("id"), seed), "id").select("vetor").limit(some).collect()], np.float64)
    fields = [*items.schema.fields, T.StructField("_centre", T.IntegerType()), T.StructField("_far", T.DoubleType()), T.StructField("_norm", T.DoubleType())]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres * centres).sum(axis=1) / 2
        for batch in batches:
            x = matrix(pa.Table.from_batches([batch]), "vetor")
            best = np.concatenate([np.argmax(x[s] @ centres.T - half, axis=1) for s in strips(len(x), len(centres))] or [np.empty(0, np.int64)])
            far = np.sqrt(((x - centres[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.int32()), pa.array(far), pa.array(np.sqrt((x * x).sum(axis=1)))], [*batch.schema.names, "_centre", "_far", "_norm"]
            )

    placed = cut_lineage(items.mapInArrow(nearest, T.StructType(fields)))
    largest = placed.groupBy("_centre").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    most = math.ceil((largest or 0) / rows)
    if most > 1:
        share = [F.lit(i / most) for i in range(1, most)]
        # a row for each centre; one with fewer parts than the largest takes every so many-th limit
        limits = placed.groupBy("_centre").agg(F.percentile_approx("_norm", F.array(*share)).alias("_cuts"), F.ceil(F.count("*") / rows).alias("_parts"))
        over = F.size(F.filter("_cuts", lambda c: c < F.col("_norm")))
        part = F.floor(over * F.col("_parts") / F.lit(most)).cast("int")
        placed = placed.join(F.broadcast(limits), "_centre").withColumn("_part", part).drop("_cuts", "_parts")
    else:
        placed = placed.withColumn("_part", F.lit(0))
    stats = placed.groupBy("_centre", "_part").agg(F.max("_far").alias("r"), F.max("_norm").alias("m"), F.count("*").alias("n"))
    stats = stats.orderBy("_centre", "_part").collect()  # a row for each cell
    number = items.sparkSession.createDataFrame([(r["_centre"], r["_part"], i) for i, r in enumerate(stats)], "_centre int, _part int, _cell int")
    kept = placed.join(F.broadcast(number), ["_centre", "_part"]).drop("_centre", "_far", "_norm", "_part")
    take = lambda name: np.array([r[name] for r in stats], np.float64)
    return Cells(kept, centres[[r["_centre"] for r in stats]], take("r"), take("m"), take("n"))


def visit_rows(table: pa.Table, names: list[str], cells: Cells | Boxes, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` and _cell for each asker and marked cell, VISIT_ROWS at a time: an asker may visit all cells."""
    x, need = matrix(table, "vetor"), numbers(table, "_need").astype(np.float64)
    kept = table.select(names)
    for part in strips(len(x), len(cells.size)):
        who, cell = np.nonzero(choose(cells.bounds(x[part]), need[part]))
        for start in range(0, len(who), VISIT_ROWS):
            some = slice(start, start + VISIT_ROWS)
            taken = kept.take(pa.array(who[some] + part.start)).append_column("_cell", pa.array(cell[some], pa.int32()))
            yield from taken.combine_chunks().to_batches()


def _visits(users: DataFrame, keys: list[str], cells: Cells | Boxes, groups: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A row for each asker and cell that ``choose`` (bounds, needed scores) marks: the asker's columns, _cell, _group."""
    fields = [f for f in users.schema.fields if f.name != "_need"]
    shared = users.sparkSession.sparkContext.broadcast(replace(cells, items=None, visited=[]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from visit_rows(pa.Table.from_batches([batch]), [f.name for f in fields], shared.value, choose)

    found = users.mapInArrow(run, T.StructType([*fields, T.StructField("_cell", T.IntegerType())]))
    return found.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))


def _met(visits: DataFrame, cells: Cells | Boxes, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame | None:
    """``kernel`` over the users and items of every visited cell; None where no cell is visited."""
    asked = cut_lineage(visits.groupBy("_cell", "_group").agg(F.count("*").alias("_users")))
    wanted = np.zeros(len(cells.size))
    for r in asked.groupBy("_cell").agg(F.sum("_users").alias("n")).collect():  # a row for each cell
        wanted[r["_cell"]] = r["n"]
    if not wanted.any():
        return None
    cells.visited.append(int(wanted @ cells.size))
    items = cells.items.join(asked.select("_cell", "_group"), "_cell")
    return visits.groupBy("_cell", "_group").cogroup(items.groupBy("_cell", "_group")).applyInArrow(kernel, schema)


def best_first(
    askers: DataFrame, keys: list[str], cells: Cells | Boxes, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    order: list[Column], n: int, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The ``n`` best rows of every asker and their ``rank``, exactly.

    ``kernel`` gives the n best rows of each asker in a cell: the keys, ``score``
    and whatever else is in ``schema``; ``order`` ranks them, by score first. Askers have ``vetor`` and unique keys.
    """
    groups = max(1, math.ceil(askers.count() / group_rows))
    place = W.partitionBy(*keys).orderBy(*order)
    best, start, step = None, 0, 2
    while start < len(cells.size):
        stop = start + step

        def choose(bounds: np.ndarray, need: np.ndarray, start: int = start, stop: int = stop) -> np.ndarray:
            """The cells from place ``start`` to ``stop`` in the order of their bounds, while these reach what is needed."""
            ranked = np.argsort(-bounds, axis=1, kind="stable")[:, start:stop]
            marked = np.zeros(bounds.shape, bool)
            np.put_along_axis(marked, ranked, True, axis=1)
            return marked & (bounds >= need[:, None])

        if best is None:
            asking = askers.withColumn("_need", F.lit(float("-inf")))
        else:
            needs = best.groupBy(*keys).agg(F.when(F.count("*") >= n, F.min("score")).alias("_need"))
            asking = askers.join(needs, keys, "left").withColumn("_need", F.coalesce("_need", F.lit(float("-inf"))))
        found = _met(_visits(asking, keys, cells, groups, choose), cells, kernel, schema)
        if found is None:
            break
        whole = found if best is None else best.drop("rank").unionByName(found)
        best = cut_lineage(whole.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= n))
        start, step = stop, 2 * step
    return best if best is not None else askers.sparkSession.createDataFrame([], schema + ", rank int")


def best_pairs(users: DataFrame, cells: Cells, n: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The ``n`` best items of every user, exactly: usuario_id, item, score, rank. Ties go to the smaller item id."""
    kinds = dict(users.dtypes)["usuario_id"], dict(cells.items.dtypes)["id"]

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        i = i.sort_by("id")
        qm, im = matrix(q, "vetor"), matrix(i, "vetor")
        who, what, score = [], [], []
        vectors, number = distinct_rows(qm)  # users with one vector are scored once
        order, begin = members(number, len(vectors))
        for part in strips(len(vectors), i.num_rows) if i.num_rows else ():
            s = vectors[part] @ im.T
            of = order[begin[part.start] : begin[part.stop]]
            row = number[of] - part.start
            rows, at = top_per_row(s, n)
            own, place = dealt(rows, row, len(s))
            who.append(of[own])
            what.append(at[place])
            score.append(s[row[own], at[place]])
        who, what = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, what))
        return pa.table({
            "usuario_id": q.column("usuario_id").take(pa.array(who, pa.int64())),
            "item": i.column("id").take(pa.array(what, pa.int64())),
            "score": pa.array(np.concatenate(score) if score else [], pa.float64()),
        })

    schema = f"usuario_id {kinds[0]}, item {kinds[1]}, score double"
    return best_first(users.select("usuario_id", "vetor"), ["usuario_id"], cells, kernel, schema, [F.desc("score"), F.col("item")], n, group_rows)


def map_reaching(
    users: DataFrame, cells: Cells, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, n: int, floor: float, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``kernel`` over every cell that can hold one of a user's ``n`` best items or any item of score ``floor`` or more."""
    needs = best_pairs(users, cells, n, group_rows).groupBy("usuario_id").agg(F.when(F.count("*") >= n, F.min("score")).alias("_least"))
    need = F.least(F.coalesce("_least", F.lit(float("-inf"))), F.lit(float(floor)))
    asking = users.join(needs, "usuario_id", "left").withColumn("_need", need).drop("_least")
    groups = max(1, math.ceil(users.count() / group_rows))
    found = _met(_visits(asking, ["usuario_id"], cells, groups, lambda bounds, need: bounds >= need[:, None]), cells, kernel, schema)
    return found if found is not None else users.sparkSession.createDataFrame([], schema)


def share_scored(users: DataFrame, cells: Cells | Boxes) -> float:
    """Pairs scored so far, as a share of all pairs of these askers and items."""
    return sum(cells.visited) / max(1.0, users.count() * float(cells.size.sum()))
