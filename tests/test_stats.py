import math

import numpy as np
import pytest

from acervo.functions import tails
from acervo.operators import stats as T
from acervo.operators.evaluate import popularity_bias


def test_tail_values_from_tables():
    assert math.isclose(tails.chi2_tail(5.991465, 2), 0.05, rel_tol=1e-5)
    assert math.isclose(tails.chi2_tail(18.307038, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(tails.t_tail(2.228139, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(tails.f_tail(4.102821, 2, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(tails.kolmogorov_tail(1.3581), 0.05, rel_tol=1e-3)
    assert tails.f_tail(1e6, 3, 50) < 1e-20 and tails.kolmogorov_tail(0.0) == 1.0


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", v) for v in (6.0, 8.0, 4.0, 5.0, 3.0, 4.0)] + [("b", v) for v in (8.0, 12.0, 9.0, 11.0, 6.0, 8.0)]
    rows += [("c", v) for v in (13.0, 9.0, 11.0, 8.0, 7.0, 12.0)]
    return spark.createDataFrame(rows + [("d", None)], "g string, v double")


def test_anova_textbook(groups):
    r = T.anova(groups, "g", "v").first()
    assert math.isclose(r["f"], 9.264706, rel_tol=1e-6) and math.isclose(r["p"], 0.002399, rel_tol=1e-3)
    assert (r["k"], r["n"]) == (3, 18)


def test_anova_needs_two_groups(groups):
    assert T.anova(groups.where("g = 'a'"), "g", "v").count() == 0


def test_kruskal_matches_direct_ranks(groups):
    r = T.kruskal(groups, "g", "v").first()
    rows = [(x["g"], x["v"]) for x in groups.where("v IS NOT NULL").collect()]
    v = np.array([x for _, x in rows])
    rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    n = len(v)
    h = 12 / (n * (n + 1)) * sum(rank[[i for i, q in enumerate(rows) if q[0] == g]].sum() ** 2 / 6 for g in "abc") - 3 * (n + 1)
    ties = sum(c**3 - c for c in np.unique(v, return_counts=True)[1])
    assert math.isclose(r["h"], h / (1 - ties / (n**3 - n)), rel_tol=1e-12)
    assert math.isclose(r["p"], tails.chi2_tail(r["h"], 2))


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert T.pearson(df, "x", "y").first()["r"] is None
    assert T.spearman(df, "x", "y").first()["rho"] is None
    recs = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "usuario_id int, rank int, item int")
    pop = spark.createDataFrame([(5, 10), (6, 99)], "item int, popularidade int")
    assert popularity_bias(recs, pop).first()["vies"] is None
    assert popularity_bias(recs, pop.where("item > 99")).first()["vies"] == 0.0


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = np.round(x + rng.normal(size=200), 1)
    z = rng.normal(size=200) + x
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)], "x double, y double, z double")
    assert math.isclose(T.pearson(df, "x", "y").first()["r"], np.corrcoef(x, y)[0, 1], rel_tol=1e-10)
    rk = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    assert math.isclose(T.spearman(df, "x", "y").first()["rho"], np.corrcoef(rk(x), rk(y))[0, 1], rel_tol=1e-10)
    res = lambda v: v - np.polyval(np.polyfit(z, v, 1), z)
    p = T.partial_corr(df, "x", "y", "z").first()
    assert math.isclose(p["r"], np.corrcoef(res(x), res(y))[0, 1], rel_tol=1e-9) and p["ci_low"] < p["r"] < p["ci_high"]


def test_ks(spark):
    a = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    b = spark.createDataFrame([(float(v) + 30,) for v in range(100)], "v double")
    r = T.ks_2samp(a, b, ["v"]).first()
    assert math.isclose(r["d"], 0.3) and not r["passou"]
    same = T.ks_2samp(a, a, ["v"]).first()
    assert same["d"] == 0.0 and same["passou"] and (same["n1"], same["n2"]) == (100, 100)


def test_exact_ks_is_enumeration():
    from itertools import combinations
    from math import comb

    for n1 in range(1, 9):
        for n2 in range(1, 9):
            worst = []
            for firsts in combinations(range(n1 + n2), n1):
                here, i, top = set(firsts), 0, 0
                for at in range(n1 + n2):
                    i += at in here
                    top = max(top, abs(i * n2 - (at + 1 - i) * n1))
                worst.append(top)
            worst = np.array(worst)
            for bound in sorted({*worst.tolist(), 0}):
                want = (worst >= bound).sum() / comb(n1 + n2, n1)
                assert math.isclose(tails.ks_exact_tail(bound / (n1 * n2), n1, n2), want, rel_tol=1e-12)


def test_exact_ks_of_larger_samples():
    # two samples that do not overlap at all: two of all paths
    assert math.isclose(tails.ks_exact_tail(1.0, 30, 20), 2 / math.comb(50, 20), rel_tol=1e-10)
    assert tails.ks_exact_tail(1.0, 300, 300) < 1e-170
    assert math.isclose(tails.ks_exact_tail(0.03, 3000, 2500), tails.kolmogorov_tail(0.03 * math.sqrt(3000 * 2500 / 5500)), rel_tol=0.05)
    assert tails.ks_exact_tail(0.2, 40, 70) == tails.ks_exact_tail(0.2, 70, 40)


def test_ks_is_exact_up_to_a_size(spark):
    a = spark.createDataFrame([(float(v),) for v in range(12)], "v double")
    b = spark.createDataFrame([(float(v) + 5.5,) for v in range(9)], "v double")
    exact = T.ks_2samp(a, b, ["v"]).first()
    assert math.isclose(exact["p"], tails.ks_exact_tail(exact["d"], 12, 9), rel_tol=1e-12)
    limit = T.ks_2samp(a, b, ["v"], exact_up_to=11).first()
    assert math.isclose(limit["p"], tails.kolmogorov_tail(limit["d"] * math.sqrt(12 * 9 / 21)), rel_tol=1e-12)


def test_enforce_types(spark):
    df = spark.createDataFrame([("3", 4), ("x", 5)], "Price string, Genres int")
    out = T.enforce_types(df)
    assert dict(out.dtypes) == {"Price": "double", "Genres": "string"}
    assert [r["Price"] for r in out.collect()] == [3.0, None]
