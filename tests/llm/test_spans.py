"""Sentence spans against a plain reading, and planted passages."""

import random
import re
import time

import pyarrow as pa

from acervo.llm import spans

STOP = re.compile(r"""[.!?]+["')\]]*(?=[ \t-\r])|\n|。|[！？]""")


def sentence_list(text):
    """(first, end, words) in characters; a piece without words belongs to what follows or, at the end, goes before."""
    data, found, at = text, [], 0
    for end in [m.end() for m in STOP.finditer(data)] + [len(data)]:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), data[at:end]).split()
        if words:
            found.append((at, words))
            at = end
    ends = [f[0] for f in found[1:]] + [len(text)]
    return [(a, e, w) for (a, w), e in zip(found, ends)]


def run_list(text):
    s = sentence_list(text)
    found = set()
    for i in range(len(s)):
        for way in (range(i + 2, len(s) + 1), range(i - 1, -1, -1)):
            for j in way:
                a, b = (i, j) if j > i else (j, i + 1)
                if b - a >= 2 and sum(len(w) for _, _, w in s[a:b]) >= spans.MIN_WORDS:
                    found.add((s[a][0], s[b - 1][1], tuple(tuple(w) for _, _, w in s[a:b])))
                    break
    return found


def brute(rows):
    places = {}
    for key, text in sorted(set(rows), key=str):
        for begin, end, words in run_list(text or ""):
            places.setdefault(words, []).append((key, text, begin, end))
    gone = {}
    for at in places.values():
        for key, text, begin, end in sorted(at, key=lambda x: (x[0], x[2]))[1:]:
            gone.setdefault((key, text), set()).update(range(begin, end))
    out = []
    for key, text in rows:
        cut = gone.get((key, text))
        out.append((key, text if not cut else "".join(c for i, c in enumerate(text) if i not in cut).strip(" \t\n\r\x0b\x0c")))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = spans.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows)


def test_passages_go_from_all_but_the_first(spark):
    passage = "One two three four five six seven eight nine ten eleven. " + "Alpha beta gamma delta epsilon zeta eta theta iota kappa! " + " ".join(f"w{i}" for i in range(32)) + "."
    assert len(passage.split()) > 50
    rows = [(i, f"Own sentence number {i} stands here. {passage} And text {i} goes on.") for i in range(5)]
    rows += [(9, f"{passage}\n{passage}\nLast line of it."), (10, "Clean text. It has short ones. It has short ones.")]
    out = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), marks=True).collect()}
    assert out[0].text == rows[0][1] and out[0].spans is None and out[0].removed_bytes == 0
    for i in range(1, 5):
        assert out[i].text == f"Own sentence number {i} stands here. And text {i} goes on."
        assert out[i].removed_bytes == len(passage) + 1
    assert out[9].text == "Last line of it."
    assert out[10].text == rows[6][1]


def test_odd_rows(spark):
    long = " ".join(f"Sentence {i} of a long text has words." for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "."), (3, "."), (None, long), (4, long), (4, long), (5, "é。" * 40 + "no spaces")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, spans string, _key int")
    got = spans.remove_repeats(docs, marks=True)
    assert got.columns == ["doc_id", "text", "_key", "spans", "removed_bytes"]
    out = got.collect()
    assert len(out) == len(rows)
    assert sorted(len(r.text or "") for r in out if r.doc_id in (None, 4)) == [0, len(long), len(long)]
    assert {r.text for r in out if r.doc_id in (1, 2, 3)} == {None, "", "."}
    assert spans.remove_repeats(docs.limit(0)).columns == docs.columns
    assert spans.remove_repeats(docs.limit(0)).count() == 0


def test_passages_without_whole_sentences(spark):
    """One long sentence, no stops at all, and passages that begin and end inside sentences: no 50 common words stay."""
    rng = random.Random(3)
    own = lambda n: " ".join(f"o{rng.random()}" for _ in range(n))
    rows = []
    for k in range(60):
        n = rng.randrange(50, 90)
        words = [f"p{rng.randrange(10**6)}" for _ in range(n)]
        if k % 3 == 2:
            for i in rng.sample(range(n), 5):
                words[i] += "."
        passage = " ".join(words)
        rows += [(2 * k, f"{own(30)} {passage} {own(30)}"), (2 * k + 1, f"{own(rng.randrange(40))} {passage} {own(rng.randrange(40))}".strip())]
        if k % 3 == 0:
            rows[-2:] = [(2 * k, passage + "."), (2 * k + 1, f"{own(5)}. {passage}. {own(5)}.")]
    out = {r.doc_id: r.text for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), cut_long=True).collect()}
    for (a, first), (b, later) in zip(rows[::2], rows[1::2]):
        assert out[a] == first
        runs_of = lambda t: {tuple(t.split()[i : i + 50]) for i in range(len(t.split()) - 49)}
        assert not runs_of(first) & runs_of(out[b])
        assert all(w in out[b] for w in later.split() if w.startswith("o0"))


def test_columns_of_any_name(spark):
    own = "A first sentence of some words stands here. And a second sentence has as many words as the first one has, or more than that."
    names = ["_spans", "_span_key", "_row_print", "_key", "_print", "~_key", "begin"]
    rows = [(i, own, *range(len(names))) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = spans.remove_repeats(docs, marks=True)
    assert got.columns == [*docs.columns, "spans", "removed_bytes"]
    assert sorted(tuple(r)[:9] for r in got.collect()) == [(1, own, *range(7)), (2, "", *range(7))]


def plain_places(text):
    found, at = [], 0
    for end in [m.end() for m in spans.STOP.finditer(text)] + [len(text)]:
        found += [m.start() + at for m in re.finditer(rb"[^ \t-\r]+", text[at:end])]
        at = end
    return found


def test_places_of_words():
    tokens = ["a", "Bc", " ", "\n", "\t", ". ", ".", "!) ", "。", "？", "é", "\x1c", "\x85", " ", "　"]
    rng = random.Random(3)
    for n in range(300):
        text = "".join(rng.choice(tokens) for _ in range(n)).encode()
        starts, counts, _, words, begins = spans.sentences(text)
        assert begins.tolist() == plain_places(text) and sum(counts) == len(words) == len(begins)


def test_runs_cost_little_more_than_finding_the_words():
    rng = random.Random(4)
    text = " ".join(rng.choice(["one", "two,", "three", "four.", "five"]) for _ in range(400)).encode()

    def best(work):
        took = []
        for _ in range(5):
            begin = time.process_time()
            for _ in range(100):
                work(text)
            took.append(time.process_time() - begin)
        return min(took)

    assert best(spans.runs) < 2.7 * best(plain_places)


def test_batches_of_texts_are_small(spark):
    from acervo.llm.shared import ARROW_ROWS, stored

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(ARROW_ROWS)
    found = stored(spark.range(0, 12_000, 1, 1).mapInArrow(sizes, "n bigint"), spans.ARROW_TEXTS)
    assert {r.n for r in found.collect()} == {spans.ARROW_TEXTS} and spark.conf.get(ARROW_ROWS) == before
    rows = spark.range(0, 1, 1, 1).selectExpr("id as _key", "id as _print", "repeat('All of it repeats, one word after the other, here. ', 200000) as _text").union(
        spark.range(0, 100, 1, 1).selectExpr("id", "id", "repeat('All of it repeats, one word after the other, here. ', 2000)")).coalesce(1)
    batches = spans._all_runs(rows, True).mapInArrow(sizes, "n bigint").collect()
    assert len(batches) > 5
