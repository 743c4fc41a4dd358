"""Session events as streams: exact ingest, windowed trends, running engagement.

Keyed state (ids that were seen, the figures of each user) lives in RocksDB stores of the
checkpoint, on disk rather than in executor memory, and outlives restarts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from acervo.session import scratch
from acervo.sources.tables import finished_sessions


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the checkpoint remembers it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream; the schema is given."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def ingest_sessions(stream: DataFrame, path: str, checkpoint: str, forget_after: str | None = None) -> StreamingQuery:
    """Append valid sessions once per event id.

    The ids that were seen are a ledger in the query's state, a row each, kept for ever, so a
    repeat is dropped however late it comes. With ``forget_after`` (such as "400 days") an id leaves the
    ledger once the stream is that far past its event.
    """
    valid = stream.where((F.col("minutos") > 0) & F.col("usuario_id").isNotNull() & F.col("jogo_id").isNotNull())
    if forget_after is None:
        once = valid.dropDuplicates(["id"])
    else:
        timed = valid.withColumn("_at", F.col("fim").cast("timestamp")).withWatermark("_at", forget_after)
        once = timed.dropDuplicatesWithinWatermark(["id"])
    with _state_on_disk(stream.sparkSession):
        return (
            finished_sessions(once)
            .writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )


def trending_stream(stream: DataFrame, days: int, slide_days: int = 1, delay: str = "1 day") -> DataFrame:
    """Sessions per game and window of ``days``; tumbling where the slide equals the width."""
    timed = stream.withColumn("_at", F.col("fim").cast("timestamp")).withWatermark("_at", delay)
    window = F.window("_at", f"{days} days", f"{slide_days} days")
    return timed.groupBy(window.alias("w"), "jogo_id").agg(F.count("*").alias("acessos")).select(
        F.col("w.start").cast("timestamp_ntz").alias("inicio"),
        F.col("w.end").cast("timestamp_ntz").alias("fim"),
        "jogo_id",
        "acessos",
    )


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write closed windows to ``path`` until the input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def engagement_stream(stream: DataFrame) -> DataFrame:
    """Running sessions, minutes and last session per user."""
    return stream.groupBy("usuario_id").agg(
        F.count("*").alias("sessoes"),
        F.sum("minutos").alias("minutos"),
        F.max("fim").alias("ultima_sessao"),
    )


def run_engagement(stream: DataFrame, checkpoint: str) -> None:
    """Fold new sessions into the state of their users: one row each, in the checkpoint, and no file for a batch.

    Sessions are added up before the shuffle, so a very active user is one row of each task. ``current_engagement`` reads the state.
    """
    with _state_on_disk(stream.sparkSession):
        query = (
            engagement_stream(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .format("noop")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def current_engagement(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions, minutes and last session of every user, as of the newest finished batch."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", "value.*").toDF("usuario_id", "sessoes", "minutos", "ultima_sessao")


def fresh_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """Output and checkpoint folders in the shared scratch area."""
    base = scratch(spark, label)
    return f"{base}/data", f"{base}/checkpoint"
