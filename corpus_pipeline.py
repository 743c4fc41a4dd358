"""The corpus pipeline: from raw documents to mixed token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of documents. run() writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm import jaccard, mixing, pieces, quality, spans
from acervo.llm.queries import piece_model
from acervo.llm.shared import dropped, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; the target is fitted on labelled good ones.

    Null and empty texts have no words and go; repeated rows are judged alike. Without labels every gram is as likely in both.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels.where("quality = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word grams: that of the smallest doc_id, null last.

    Of repeated rows one stays. Texts without words, null ones among them, all stay.
    """
    return jaccard.keep_first_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats: runs of sentences, and of pieces of long sentences. No row goes.

    n_chars follows the text. Null and empty texts stay; a text may become empty.
    """
    done = spans.remove_repeats(docs, cut_long=True)
    if "n_chars" in done.columns:
        length = F.char_length("text").cast(done.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return done


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted so that every stretch holds the sources by their target weights.

    A null source is a source of its own; null and empty texts take no room; repeated rows are placed each.
    """
    return mixing.mixed_order(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the packed ids of every document, with slot and offset in the mix and sorted by them.

    Files read again come in any order, so the place of a row is worked out from
    the same rows that source_mix sorted, which gives the same place, and stays with the row.
    """
    def encode(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        done = pieces.encode_texts(rows, piece_model(), keep=(*keep, "lang", "source"))
        return done.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).drop("decoded")

    return mixing.mixed_after(docs, encode).select("doc_id", "lang", "source", "n_tokens", "ids", "slot", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mix", source_mix),
    ("sentencepiece", piece_ids),
]

ORACLE_SQL = None  # hashed grams, schedules and merges are beyond SQL; tests/llm/test_pipeline.py has the plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for documents; what a stage before it wrote goes once the next one has written.

    Stages say what they do with nulls, empty and repeated rows. Documents may have columns of any names, all but
    the last stage keep them. An empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            dropped(last)
    return docs
