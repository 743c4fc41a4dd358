"""Cell-by-cell search against scoring every pair."""

import numpy as np
import pyarrow as pa
import pytest

from acervo.operators import pruned as P, recommend as R
from acervo.operators.tiles import strips


def key(df):
    return sorted(tuple(r) for r in df.collect())


def frames(spark, users, items):
    u = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(users)], "usuario_id bigint, vetor array<double>")
    v = spark.createDataFrame([(1000 + i, x.tolist()) for i, x in enumerate(items)], "id bigint, vetor array<double>")
    return u, v


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 4
    items = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.3
    users = centres[rng.integers(0, 12, 90)] + rng.normal(size=(90, 8)) * 0.5
    items[5] = items[6] = items[7]  # ties
    users[3] = 0.0  # all scores equal
    return users, items


def best(users, items, n):
    s = users @ items.T
    return {u: sorted(range(len(items)), key=lambda i: (-s[u, i], i))[:n] for u in range(len(users))}, s


def test_best_items_are_those_of_all_pairs(spark, clustered):
    users, items = clustered
    u, v = frames(spark, users, items)
    cells = P.build_cells(v, rows=40)
    assert cells.size.sum() == 1500 and len(cells.size) > 20 and cells.items.count() == 1500
    got = {}
    for r in P.best_pairs(u, cells, 7, group_rows=25).collect():
        got.setdefault(r["usuario_id"], {})[r["rank"]] = r["item"] - 1000
    want, _ = best(users, items, 7)
    assert {u: [m[k] for k in sorted(m)] for u, m in got.items()} == want
    assert P.share_scored(u, cells) < 0.5


def test_bounds_hold(clustered):
    users, items = clustered
    centre = items[11]
    cells = P.Cells(None, centre[None, :], np.array([np.sqrt(((items - centre) ** 2).sum(axis=1)).max()]), np.array([np.sqrt((items**2).sum(axis=1)).max()]), np.array([1500.0]))
    assert ((users @ items.T).max(axis=1) <= cells.bounds(users)[:, 0]).all()


def test_same_lists_with_cells_and_without(spark, clustered):
    users, items = clustered
    u, v = frames(spark, users * 0.05, items * 0.3)
    assert [r[:2] + r[3:] for r in key(R.top_items(u, v, 5, cell_rows=60).select("usuario_id", "rank", "score", "item"))] == [
        r[:2] + r[3:] for r in key(R.top_items(u, v, 5).select("usuario_id", "rank", "score", "item"))]
    for cell_rows in (60,):
        whole = R.recommend_modes(u, v, 10).select("usuario_id", "modo", "rank", "item", "origem")
        assert key(R.recommend_modes(u, v, 10, cell_rows=cell_rows).select("usuario_id", "modo", "rank", "item", "origem")) == key(whole)
        whole = R.items_above(u, v, 0.9, 3).select("usuario_id", "item")
        assert key(R.items_above(u, v, 0.9, 3, cell_rows=cell_rows).select("usuario_id", "item")) == key(whole)
        truth = spark.createDataFrame([(i, 1000 + i * 7) for i in range(90)], "usuario_id bigint, item bigint")
        assert key(R.best_thresholds(u, v, truth, cell_rows=cell_rows)) == key(R.best_thresholds(u, v, truth))


def test_threshold_lists(spark, clustered):
    users, items = clustered
    u, v = frames(spark, users * 0.05, items * 0.3)
    scores = (users * 0.05) @ (items * 0.3).T
    for cell_rows in (60, 20_000):
        got = {}
        for r in R.threshold_lists(u, v, 0.9, 3, 8, cell_rows=cell_rows).collect():
            got.setdefault(r["usuario_id"], []).append((r["rank"], r["item"] - 1000, r["n_valid"]))
        for i in range(90):
            n = int((scores[i] >= 0.9).sum())
            order = sorted(range(1500), key=lambda j: (-scores[i, j], j))[: min(n, 8) if n else 6]
            assert sorted(got[i]) == [(k + 1, j, n) for k, j in enumerate(order)]


def test_one_wanted_cell_and_few_items(spark):
    rng = np.random.default_rng(1)
    items = rng.normal(size=(30, 4))
    users = np.repeat(items[:1], 200, axis=0)  # all users want the same cell
    u, v = frames(spark, users, items)
    got = P.best_pairs(u, P.build_cells(v, rows=3), 50, group_rows=9)
    assert got.count() == 200 * 30  # fewer items than asked for
    assert key(got.where("rank = 1").select("item").distinct()) == [(1000 + best(users, items, 1)[0][0][0],)]


def test_memory_of_a_block_and_of_a_batch_of_visits_is_bounded():
    n_cells, n = 4096, 300
    for items in (2_000, 20_000, 100_000):
        assert max(part.stop - part.start for part in strips(20_000, items)) * items * 8 <= 8_000_000
    cells = P.Cells(None, np.zeros((n_cells, 64)), np.ones(n_cells), np.ones(n_cells), np.ones(n_cells))
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(np.ones(64 * n)), 64).cast(pa.list_(pa.float64()))
    table = pa.table({"usuario_id": np.arange(n), "vetor": vectors, "_need": np.zeros(n)})
    rows, most, before = 0, 0, pa.total_allocated_bytes()
    for batch in P.visit_rows(table, ["usuario_id", "vetor"], cells, lambda bounds, need: bounds > -np.inf):  # all visit all cells
        rows += batch.num_rows
        most = max(most, pa.total_allocated_bytes() - before)
        assert batch.num_rows <= 10_000
    assert rows == n * n_cells and most < 30_000_000  # in one piece they would be 640 MB
