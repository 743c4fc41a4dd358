"""Quoted CSV read by many tasks, also where texts hold line ends.

A file is read by byte ranges as lines. Whether a range begins inside a quoted
text follows from the number of quotes before it: each range counts its own, and a
running parity over the ranges of a file settles it. A range then knows where its rows
begin and end; what lies before its first row end and after its last one are pieces
of rows that other ranges share, at most two a range, put together by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

ROW, HEAD, INNER, TAIL = 0, 1, 2, 3  # a whole row; the end, a middle and the start of one that ranges share
BATCH_BYTES = 4 << 20


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the first byte of the range they were read in; lines of a range come in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("inicio"))


def range_parity(lines: DataFrame) -> DataFrame:
    """(arquivo, inicio, aberto): whether a range begins inside a quoted text."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = lines.groupBy("arquivo", "inicio").agg((F.sum(quotes) % 2).alias("impar"))
    earlier = W.partitionBy("arquivo").orderBy("inicio").rowsBetween(W.unboundedPreceding, -1)  # the ranges of one file, a row each
    return odd.select("arquivo", "inicio", (F.coalesce(F.sum("impar").over(earlier), F.lit(0)) % 2 == 1).alias("aberto"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and pieces of rows of ranges whose lines come in order."""
    at, pending, kind = None, [], ROW
    out: dict[str, list] = {"arquivo": [], "inicio": [], "tipo": [], "primeira": [], "texto": []}
    held, fresh, inside = 0, False, False

    def put(kind: int, text: str) -> None:
        nonlocal held, fresh
        if kind != ROW or text.strip("\r"):
            for name, v in zip(out, (*at, kind, fresh and kind in (ROW, TAIL), text), strict=True):
                out[name].append(v)
            held += len(text) + 50
            if kind != HEAD and kind != INNER:
                fresh = False

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal out, held
        if out["texto"]:
            yield pa.RecordBatch.from_pydict({
                "arquivo": pa.array(out["arquivo"]), "inicio": pa.array(out["inicio"], pa.int64()), "tipo": pa.array(out["tipo"], pa.int32()),
                "primeira": pa.array(out["primeira"], pa.bool_()), "texto": pa.array(out["texto"]),
            })
        out, held = {name: [] for name in out}, 0

    def close() -> None:
        """What is left at the end of a range goes on in the next one."""
        if pending:
            put(INNER if kind == HEAD else TAIL, "\n".join(pending) + "\n")

    for batch in batches:
        for value, file, start, open_ in zip(*(batch.column(c).to_pylist() for c in ("value", "arquivo", "inicio", "aberto")), strict=True):
            if (file, start) != at:
                if at is not None:
                    close()
                at, pending, inside, kind, fresh = (file, start), [], open_, HEAD if open_ else ROW, start == 0
            pending.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                put(kind, "\n".join(pending))
                pending, kind = [], ROW
            if held > BATCH_BYTES:
                yield from flush()
    if at is not None:
        close()
    yield from flush()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows of quoted CSV files as texts: arquivo, primeira (the first row of its file), texto."""
    lines = _lines(spark, path)
    # a row for each byte range of the files; an order in the task keeps lines in place whatever the join does
    ranges = range_parity(lines).withColumnsRenamed({"arquivo": "_a", "inicio": "_i"})
    placed = lines.withColumn("_n", F.monotonically_increasing_id())
    known = placed.join(F.broadcast(ranges), (F.col("arquivo") == F.col("_a")) & (F.col("inicio") == F.col("_i")), "left")
    # ranges are those of the first reading, else the file was cut anew in between
    same = F.when(F.col("aberto").isNull(), F.raise_error(F.lit("the byte ranges changed between two readings"))).otherwise(F.col("aberto"))
    ordered = known.select("value", "arquivo", "inicio", same.cast("boolean").alias("aberto"), "_n").sortWithinPartitions("_n")
    found = ordered.mapInArrow(_pieces, "arquivo string, inicio bigint, tipo int, primeira boolean, texto string")
    whole = found.where(F.col("tipo") == ROW).select("arquivo", "primeira", "texto")
    parts = found.where(F.col("tipo") != ROW)
    # pieces in the order of their file: a tail begins a row, what follows belongs to it
    in_file = W.partitionBy("arquivo").orderBy("inicio", "tipo")  # two rows for each range at most
    row = F.sum(F.when(F.col("tipo") == TAIL, 1).otherwise(0)).over(in_file)
    joined = parts.withColumn("_row", row).groupBy("arquivo", "_row").agg(
        F.max("primeira").alias("primeira"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inicio", "tipo", "texto"))), lambda x: x["texto"]), "").alias("texto")
    )
    return whole.unionByName(joined.select("arquivo", "primeira", "texto"))


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV files with a header as a table, split by byte ranges also where quoted texts hold line ends.

    Rows are those of a reader with ``multiLine`` and the quote as escape. Quotes stand
    around whole fields and are doubled inside them.
    """
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    records = csv_records(spark, path)
    if header:
        records = records.where(~F.col("primeira"))
    text = F.regexp_replace("texto", r"\r\z", "")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv(text, types, {"escape": '"', "multiLine": "true"})
    return records.select(parsed.alias("_r")).select("_r.*")
