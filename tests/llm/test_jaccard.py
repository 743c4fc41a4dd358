"""The Jaccard join against all pairs of sets."""

import random
import re

import pytest

from acervo.llm import jaccard
from acervo.llm.components import components


def gram_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [gram_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_whole_table(spark, sf, size, percent):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(jaccard.similar_sets(docs, size, percent)) == brute(rows, size, percent)


def near_copies(n, seed, groups=3):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(groups)]
    rows = []
    for i in range(n):
        words = list(bases[i % groups]) if i % 5 else [f"v{rng.randrange(60)}" for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rounds, most", [(8, 0), (2, 0), (0, 0), (8, 10**9)])
def test_groups_of_near_copies(spark, monkeypatch, rounds, most):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", most)
    rows = near_copies(150, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.similar_sets(docs, 4, 85)) == brute(rows, 4, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (None, "a b c d e f"), (None, "a b c d e f"),
            (6, "É b"), (7, "é b"), (8, "long " * 20_000), (9, "Long " * 20_001), (10, "a b c d e f"), (11, "x")]
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "doc_id long, text string, n_shingles int, class string")
    got = jaccard.similar_sets(docs, 4, 85)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(got) == brute(rows, 4, 85)
    assert jaccard.similar_sets(docs.limit(0)).count() == 0
    assert jaccard.similar_sets(docs.where("doc_id < 4")).count() == 3


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f"), (4, ""), (2, "q r s t"), (5, "zz"), (5, "zz")]
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, _key string")
    kept = jaccard.keep_first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (2, "q r s t"), (3, None), (3, None), (4, ""), (5, "zz")], key=str)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (60, 50), (50, 60), (70, 60), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_any_name(spark):
    names = ["_k", "_key", "_print", "_n", "_root", "_low", "class", "~_k"]
    rows = [(i, f"a b c d e f g h i j {'x' if i < 3 else i}", *range(8)) for i in (1, 2, 3)] + [(1, "other words in this text of that same key", *range(8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = jaccard.keep_first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted([rows[0], rows[2], rows[3]])


@pytest.mark.parametrize("percent", [60, 85])
def test_passages_that_many_unlike_texts_share(spark, monkeypatch, percent):
    """Hot grams at the end of their sets pair nothing by themselves, and near copies among such texts are all found."""
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([10, 60, 150]))]
        words[len(words) // 2 : len(words) // 2] = passage
        rows.append((2 * i, " ".join(words)))
        near = list(words)
        for _ in range(rng.choice([0, 1, 3, 9])):
            near[rng.randrange(len(near))] = f"n{rng.random()}"
        rows.append((2 * i + 1, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (jaccard.PAIRS_PER_POSTING, 1e9):
        monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", most)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_sets(docs, 4, percent).collect())
        assert got == sorted(brute(rows, 4, percent))


def test_a_large_group_of_near_copies_is_compared_with_its_middle(spark, monkeypatch):
    """Sets with few words of their own link most of the group, so few pairs are left, and the components are those of all pairs."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(min(i, 1 + i % 6)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    compared = []

    def counted(pairs, *more, linked=jaccard._linked):
        compared.append(pairs.count())
        return linked(pairs, *more)

    monkeypatch.setattr(jaccard, "_linked", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.similar_sets(docs, 4, 85)) == brute(rows, 4, 85)
    assert sum(compared) < 8 * len(rows), compared


def test_pairs_far_from_the_threshold_need_no_whole_sets(spark, monkeypatch):
    """What both ends of the hash order lack adds up: sets that share 6 of 10 grams, the rare ones, go before whole sets are made."""
    rng = random.Random(5)
    tails = [[f"t{k}_{j}" for j in range(240)] for k in range(4)]
    rows = []
    for i in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(360)]
        rows += [(2 * i, " ".join(base + tails[i % 2])), (2 * i + 1, " ".join(base + tails[2 + i % 2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = []

    def counted(texts, size, sets=jaccard._sets):
        whole.append(texts.count())
        return sets(texts, size)

    monkeypatch.setattr(jaccard, "_sets", counted)
    assert result(jaccard.similar_sets(docs, 4, 85)) == brute(rows, 4, 85)
    assert sum(whole) <= 8, whole


@pytest.mark.parametrize("percent", [30, 50, 85, 100])
def test_ends_of_small_sets_overlap(spark, percent):
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.similar_sets(docs, 1, percent)) == brute(rows, 1, percent)
