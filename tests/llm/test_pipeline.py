"""The pipeline's stages against a plain reading of each, one after another."""

import math
import struct

import pytest
import sentencepiece
from test_jaccard import brute as groups
from test_quality import base, grams

import corpus_pipeline
from acervo.llm import mixing, quality, spans
from acervo.llm.queries import piece_model


def without_repeats(docs):
    """Every run of a text, by its words' hash; what a run covers goes from all places but the first."""
    places, gone = {}, {}
    for key, text in sorted(set(docs)):
        for h, begin, end in zip(*spans.runs(text.encode(), True)):
            places.setdefault(int(h), []).append((key, text, int(begin), int(end)))
    for found in places.values():
        for key, text, begin, end in sorted(found, key=lambda p: (p[0], p[2]))[1:]:
            gone.setdefault((key, text), set()).update(range(begin, end))
    for key, text in docs:
        cut = gone.get((key, text))
        yield key, text if not cut else bytes(b for i, b in enumerate(text.encode()) if i not in cut).strip().decode()


def passes(docs, trusted):
    raw, target = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for i, t in docs:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in trusted
    shift = math.log(sum(raw)) - math.log(sum(target))
    for i, t in docs:
        n, *_, repeated = base(t)
        found = grams(t)
        if n >= 20 and 100 * repeated <= 30 * n and sum(math.log(target[g] / raw[g]) + shift for g in found) / len(found) >= quality.THRESHOLD:
            yield i, t


@pytest.fixture(scope="module")
def plain(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    good = list(passes(docs, trusted))
    first = {key for key, _, low in groups(good, 5, 80) if key == low}
    unique = [d for d in good if d[0] in first]
    clean = list(without_repeats(unique))
    return [docs, good, unique, clean, clean]


def test_stages(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain[1:]):
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, sf))
        assert docs.columns == columns, name
        rows = docs.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(want), name
        assert all(r.n_chars == len(r.text) for r in rows)


def test_whole_run(spark, sf, plain):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {i for i, _ in plain[-1]} and len(got) < len(plain[0])
    for i, text in plain[-1]:
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[i].n_tokens == len(ids)


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30, None, None, 5), (2, "a b c d e f g h i j k l m n o p q r s t u v", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == (1 if name == "full" else 0)


def test_columns_of_any_name(spark, tmp_path):
    names = ["_name", "_k", "_spans", "_print", "_slot"]
    good = [(i, " ".join(f"w{(i * 37 + j * j) % 400}" for j in range(60)), "en", "s", 1, *range(5)) for i in range(20)]
    docs = spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out)
    assert docs.where("_name = 0 and _slot = 4").count() == docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_mix_survives_files_read_in_any_order(spark, sf):
    rows = [(i, "word and more words here. " * (300 + i % 7 * 100), "en", s, 0) for s, (a, b) in {"a": (0, 70), "b": (100, 120), None: (200, 207)}.items() for i in range(a, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(6)
    plan = {r.doc_id: (r.slot, r.offset) for r in mixing.mix_plan(docs).collect()}
    mixed = corpus_pipeline.stored(corpus_pipeline.source_mix(spark, docs, sf))
    out = corpus_pipeline.stored(corpus_pipeline.piece_ids(spark, mixed.repartition(5), sf)).collect()
    assert {r.doc_id: (r.slot, r.offset) for r in out} == plan and len(out) == len(rows)
    chars = {r[0]: (r[3], len(r[1])) for r in rows}
    totals = {s: sum(n for t, n in chars.values() if t == s) for s in ("a", "b", None)}
    whole = sum(n**mixing.EXPONENT for n in totals.values())
    end = min(int(n / mixing.BLOCK_CHARS / (n**mixing.EXPONENT / whole)) for n in totals.values())  # until the first source has no blocks left
    assert end >= 12
    for slot in range(1, end):
        for s, n in totals.items():
            begun = {r.slot for r in out if r.source == s and r.slot < slot}
            assert abs(len(begun) - n**mixing.EXPONENT / whole * slot) < 1.1, (s, slot)


def test_run_is_sorted_into_the_mix(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert [(r.slot, r.offset) for r in out] == sorted((r.slot, r.offset) for r in out)
