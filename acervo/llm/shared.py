"""Small helpers the operators share: batches of texts, written tables, words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch

SPACES = r"[ \t-\r]"  # the six ASCII spaces; everything else belongs to a word
BATCH_BYTES = 8 << 20


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for what is written inside."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: a cut in the lineage that survives lost executors.

    The shuffle files behind it go as soon as it is written. With `arrow_rows`, Python gets batches of so many rows:
    10,000 texts are 20 MB and more at once, in the JVM and in each Python worker.
    """
    spark = df.sparkSession
    path = scratch(spark, "llm")
    with _settings(spark, {CLEAN_UP: "true", **({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})}):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def stored_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """stored() in buckets of a column, as a table of the session: what is grouped by the column is then read without a shuffle."""
    spark = df.sparkSession
    path = scratch(spark, "llm")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _settings(spark, {CLEAN_UP: "true"}):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    written = spark.table(name)
    written.written_to = path
    return written


def dropped(*frames: DataFrame | None) -> None:
    """Remove the files of frames that stored() gave and that nothing reads any more; other frames and None stay as they are."""
    for frame in frames:
        if frame is not None and (path := frame.__dict__.pop("written_to", None)):
            spark = frame.sparkSession
            file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, True)


def covered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with other names for columns that begin with an underscore, as those of the operators do, and the new name of each column."""
    names = {}
    for c in docs.columns:
        new = c
        while new.startswith("_") or (new != c and new in docs.columns):
            new = f"~{new}"
        names[c] = new
    return docs.toDF(*names.values()), names


def text_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches so that one holds about `most` bytes of the text column (at least one row); give the texts as bytes."""
    for batch in batches:
        data = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        start, size = 0, 0
        lengths = pc.binary_length(data).fill_null(0).to_pylist()
        for row, length in enumerate(lengths):
            if size and size + length > most:
                yield batch.slice(start, row - start), data.slice(start, row - start).to_pylist()
                start, size = row, 0
            size += length
        if len(lengths) > start:
            yield batch.slice(start), data.slice(start).to_pylist()


def columns(batch: pa.RecordBatch, names: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of some columns of another and new ones."""
    kept = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    return pa.RecordBatch.from_pydict(kept | extra)


def words(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of anything but the six ASCII spaces."""
    return text.lower().split() if text else []
