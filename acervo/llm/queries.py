"""The registered queries opN_<name>: each gets its rows through its operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_search, byte_words, html_text, jaccard, markov, mixing, pieces, quality, spans, token_trees, toxicity, turns, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.quality_report(table(spark, sf_dir, "documents"), trusted)


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the text that stays, the byte spans removed and their number of bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs, marks=True, cut_long=True)


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_sets(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.lm_scores(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """The default model file: the public vocabulary installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op10_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digest(pieces.encode_texts(table(spark, sf_dir, "documents"), piece_model()))


@query
def op4_vector_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def byte_vocabulary() -> str:
    """The default byte-level vocabulary: the public file installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op8_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document before and after its cleaning edits: doc_id, n_tokens, n_edits, n_tokens_after, encoded_chars."""
    trees = token_trees.count_trees(table(spark, sf_dir, "documents"), byte_vocabulary())
    edited = token_trees.apply_edits(token_trees.with_cleaning_edits(trees.withColumn("doc_id", F.struct("doc_id", "n_tokens"))), byte_vocabulary())
    return edited.select("doc_id.doc_id", "doc_id.n_tokens", "n_edits", F.col("n_tokens").alias("n_tokens_after"), "encoded_chars")


@query
def op11_byte_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_words.encode_texts(table(spark, sf_dir, "documents"), byte_vocabulary())
    return byte_words.encoding_digest(byte_words.decode_ids(encoded, byte_words.token_bytes(spark, byte_vocabulary())))


@query
def op12_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bit_search.build_index(table(spark, sf_dir, "documents"))
    return bit_search.search(index, table(spark, sf_dir, "benchmark"))


SQL["op12_bit_search"] = f"""
WITH pieces AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{bit_search.TERM}') AS found
    FROM documents
), tf AS (
    SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(found) AS term FROM pieces) GROUP BY r, doc_id, term
), lengths AS (
    SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r
), totals AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{bit_search.TERM}')) AS term
    FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
), scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (r), totals
    GROUP BY item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))
