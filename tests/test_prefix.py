import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.functions.prefix import average_ranks, exact_quantiles, running_totals, upper_median
from acervo.functions.sampling import split_frac, split_stratified
from acervo.operators.profile import percentile_linear, summary_stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(rng.choice("aab"), round(rng.lognormvariate(0, 2), 2) if rng.random() < 0.5 else 7.0) for _ in range(900)]
    return data, spark.createDataFrame(data, "g string, v double")


@pytest.mark.parametrize("pieces", [2, 5, 60])
def test_running_totals_match_a_plain_scan(spark, rows, pieces):
    data, df = rows
    cells = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r["g"], r["v"]): (r["n_before"], r["n_total"]) for r in running_totals(cells, "v", ["n"], ["g"], pieces=pieces).collect()}
    for g in "ab":
        mine = [v for k, v in data if k == g]
        for v in set(mine):
            assert got[(g, v)] == (sum(x < v for x in mine), len(mine))


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "v double")
    got = {r["v"]: r["avg_rank"] for r in average_ranks(df, "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_quantiles_match_numpy_for_every_layout(spark, rows):
    data, df = rows
    want = {g: np.quantile([v for k, v in data if k == g], [0.5, 0.9, 0.951]) for g in "ab"}
    for parts in (1, 7):
        out = exact_quantiles(df.repartition(parts), "v", {"a": 0.5, "b": 0.9, "c": 0.951}, ["g"]).collect()
        for r in out:
            assert np.allclose([r["a"], r["b"], r["c"]], want[r["g"]], atol=1e-12)


def test_quantile_of_one_value_and_of_nothing(spark):
    df = spark.createDataFrame([(3.0,)], "v double")
    assert exact_quantiles(df, "v", {"q": 0.95}).first()["q"] == 3.0
    assert percentile_linear(df.where("v > 9"), "v", 0.5).first()["percentil"] == 0.0
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert percentile_linear(four, "v", 0.5).first()["percentil"] == 2.5


def test_summary_uses_upper_median_and_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = summary_stats(df, "v").first()
    assert (r["media"], r["mediana"]) == (4.0, 3.0)
    assert math.isclose(r["desvio"], np.std([1, 2, 3, 10]))
    e = summary_stats(df.where("v < 0"), "v").first()
    assert (e["media"], e["mediana"], e["desvio"]) == (0.0, 0.0, 0.0)
    assert upper_median(df, "v").first()["mediana"] == 3.0


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a, b = split_frac(df, "id", 0.7)
    assert a.count() + b.count() == 1000 and a.join(b, "id").count() == 0
    assert 600 < a.count() < 800
    for parts in (1, 9):
        s = split_stratified(df.repartition(parts), "id", ["y"], 0.2, 0.125)
        got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
        assert got == {(0, "test"): 180, (0, "val"): 90, (0, "train"): 630, (1, "test"): 20, (1, "val"): 10, (1, "train"): 70}


def test_same_sample_for_every_layout(spark):
    from acervo.functions.sampling import sample_n

    df = spark.range(500).withColumn("k", F.concat(F.lit("k"), "id"))
    one = {r["k"] for r in sample_n(df, 40, "k").collect()}
    assert one == {r["k"] for r in sample_n(df.repartition(7), 40, "k").collect()} and len(one) == 40


def test_cells_leave_no_shuffle_files(spark, monkeypatch):
    """The folded cells are written by a way that removes the shuffle files behind them at once."""
    from acervo import session
    from acervo.functions import prefix

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if "shuffle_" in f}
    left = []

    def written(df):
        before = shuffles()
        out = session.written(df)
        left.append(len(shuffles() - before))
        return out

    monkeypatch.setattr(prefix, "written", written)
    cells = spark.range(900).selectExpr("id % 9 AS v").repartition(5).groupBy("v").count()
    run = prefix.running_totals(cells, "v", ["count"])
    assert [(r["v"], r["count_before"]) for r in run.orderBy("v").collect()] == [(i, 100 * i) for i in range(9)]
    assert left == [0]
