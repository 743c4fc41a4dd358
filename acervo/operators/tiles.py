"""Block-wise scoring of two vector sets.

Both sides are cut into blocks by a hash of their unique key; every pair of
blocks is one group of a co-grouped map. Inside a group the scores are one
matrix product, and only the best few rows per query leave it. Nothing passes
through the driver, no side is broadcast and no pair table is written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acervo.session import shuffle_width

STRIP_CELLS = 1_000_000  # a strip's scores and their copies are 8 MB each, whatever the block


def block_counts(n_left: int, n_right: int, rows: int, width: int) -> tuple[int, int]:
    """Blocks per side: at most ``rows`` rows each, and enough for ``width`` tasks."""
    right = max(1, math.ceil(n_right / rows))
    left = max(math.ceil(n_left / rows), min(math.ceil(width / right), math.ceil(n_left / 500)), 1)
    return left, right


def tile_map(
    queries: DataFrame,
    items: DataFrame,
    q_key: str,
    i_key: str,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    rows: int = 20_000,
) -> DataFrame:
    """Apply ``kernel`` to every (query block, item block) pair."""
    nq, ni = block_counts(queries.count(), items.count(), rows, shuffle_width(queries.sparkSession))

    def cut(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        df = df.select(*[F.col(c).alias(c) for c in df.columns])  # own column ids: both sides may share a source
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(other, copies)

    left = cut(queries, q_key, "_q", nq, "_i", ni)
    right = cut(items, i_key, "_i", ni, "_q", nq)
    return left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(kernel, schema)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """An array column as a dense matrix."""
    col = table.column(column).combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def strips(n_queries: int, n_items: int) -> Iterator[slice]:
    """Row ranges whose score matrix stays small."""
    step = max(1, STRIP_CELLS // max(1, n_items))
    for start in range(0, n_queries, step):
        yield slice(start, min(start + step, n_queries))


def top_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` largest scores per row.

    Equal scores go to the smaller column, so columns must come in tie order.
    """
    n = scores.shape[1]
    k = min(k, n)
    if k == 0 or scores.shape[0] == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    bound = np.partition(scores, n - k, axis=1)[:, n - k]
    rows, cols = np.nonzero(scores >= bound[:, None])
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def distinct_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix, and for each of its rows the number of its distinct one."""
    if not m.size:
        return m, np.zeros(len(m), np.int64)
    whole = np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return m[first], number.ravel()


def members(number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows ordered by their number, and where each of the numbers 0..n begins among them."""
    order = np.argsort(number, kind="stable")
    return order, np.searchsorted(number[order], np.arange(n + 1))


def dealt(rows: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For askers that share rows 0..n: each asker beside the places in ``rows`` (ascending) of its own row, ``row``."""
    begin = np.searchsorted(rows, np.arange(n + 1))
    size = (begin[1:] - begin[:-1])[row]
    first = np.repeat(begin[row] - (np.cumsum(size) - size), size)
    return np.repeat(np.arange(len(row)), size), np.arange(size.sum()) + first
