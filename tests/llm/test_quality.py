"""Quality rules against a plain reading in Python."""

import math
import re

import pytest
import xxhash

from acervo.llm import quality


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    words, text = words_of(text), text or ""
    lines = [x for x in text.split("\n") if words_of(x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def chained(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS


def grams(text):
    w = words_of(text)
    return [chained(x) for x in w] + [chained(a, b) for a, b in zip(w, w[1:])]


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for i, t in docs.items():
        for g in grams(t):
            raw[g] += 1
            target[g] += i in trusted
    shift = math.log(sum(raw)) - math.log(sum(target))
    got = quality.quality_report(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("quality = 1")).collect()
    assert len(got) == len(docs)
    for r in got:
        n, *counts = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *counts)
        assert r.base_failed == (n < 20 or 100 * counts[-1] > 30 * n)
        found = grams(docs[r.doc_id])
        llr = sum(math.log(target[g] / raw[g]) + shift for g in found) / max(1, len(found))
        assert r.llr == pytest.approx(llr, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x\nx\n \n \nx", "é é é é é é é é é", "# ## <b>|", "a  b\x0bc\x0cd e", "w " * 30_000, "a b c d e f g h i " * 3]
    rows = [(i, t, 1.5, True) for i, t in enumerate(texts)] + [(None, "a", 0.0, False), (3, texts[3], 0.0, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, llr double, kept boolean")
    got = quality.quality_report(docs, spark.createDataFrame([(None,), (3,)], "doc_id long"))
    assert got.columns[:2] == ["doc_id", "n_words"] and len(got.columns) == 9
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r.doc_id] if r.doc_id is not None else "a"
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text), text and text[:40]
    assert quality.quality_report(docs.limit(0), docs.limit(0)).count() == 0
    kept = quality.keep_good(docs, docs.limit(0))
    assert kept.columns == docs.columns


def test_no_python_on_the_main_path(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.quality_report(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
