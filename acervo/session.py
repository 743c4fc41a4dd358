"""Session defaults, shared scratch folders and lineage cuts."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPREAD_ROWS = 10_000, 200_000  # of a partition: no fewer while cores are left, and no more

PIECE_ROWS = 500_000

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "acervo", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; extra ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors of a cluster this package, so that functions in tasks find it wherever the driver runs."""
    if spark.sparkContext.master.startswith("local"):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="acervo-"), "acervo.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used in local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="acervo-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    spark = df.sparkSession
    root = shared_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, buckets: int = 0, *by: str) -> DataFrame:
    """The rows as Parquet in the shared folder; the shuffle files behind them go as soon as they are written.

    In ``buckets`` of some columns, as a table of the session, what is grouped by these columns is read without a shuffle.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "rows")
    with _clean_shuffles(spark):
        if buckets:
            name = path.rsplit("/", 1)[1].replace("-", "_")
            df.repartition(buckets, *by).write.format("parquet").option("path", path).bucketBy(buckets, *by).saveAsTable(name)
        else:
            df.write.parquet(path)
    out = spark.table(name) if buckets else spark.read.schema(df.schema).parquet(path)
    out.written_to, out.named = path, name if buckets else None
    return out


def removed(*frames: DataFrame) -> None:
    """Remove the files of frames of ``written`` that nothing reads any more."""
    for frame in frames:
        if path := frame.__dict__.pop("written_to", None):
            context = frame.sparkSession.sparkContext
            file = context._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(context._jsc.hadoopConfiguration()).delete(file, True)
            if frame.named:
                frame.sparkSession.sql(f"DROP TABLE IF EXISTS {frame.named}")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows written anew, dealt by their unique key over the cores and in its order, for what iterates over them.

    Adaptive execution goes by bytes and would leave some hundred thousand narrow rows in a single partition.
    """
    df = cut_lineage(df)
    n, (few, many) = df.count(), SPREAD_ROWS
    pieces = max(1, min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / few)), math.ceil(n / many))
    return cut_lineage(df.repartition(pieces, key).sortWithinPartitions(key))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows dealt by keys into pieces of some PIECE_ROWS of the ``rows`` expected, so that a task's hash table does not grow with the input.

    Adaptive execution goes by bytes of the shuffle and by the number of cores, so a task's part grows until it has 64 MB.
    """
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / PIECE_ROWS))
    return df.repartition(pieces, *keys)


def shuffle_width(spark: SparkSession) -> int:
    """How many pieces a hot group is cut into."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

