import datetime as dt

import pytest
from pyspark.sql import functions as F

from acervo.streaming import sessions as ST

SCHEMA = "id bigint, usuario_id bigint, jogo_id bigint, minutos double, fim timestamp_ntz"


def key(df):
    return sorted(tuple(r) for r in df.collect())


def day(n, hour=1):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


@pytest.fixture()
def folder(spark, tmp_path):
    path = tmp_path / "in"

    def put(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(path / name))

    def stream(per_trigger=1):
        schema = spark.createDataFrame([], SCHEMA).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).parquet(str(path))

    return put, stream, tmp_path


def test_ingest_is_exact_and_resumes(spark, folder):
    put, stream, tmp = folder
    put("a", [(1, 1, 5, 30.0, day(0)), (1, 1, 5, 30.0, day(0)), (2, 1, 5, 0.0, day(0)), (3, None, 5, 9.0, day(0))])
    out, check = str(tmp / "out"), str(tmp / "check")
    ST.ingest_sessions(stream(), out, check).awaitTermination()
    put("b", [(1, 1, 5, 30.0, day(0)), (4, 2, 6, 60.0, day(0, 2))])
    for _ in range(2):  # the second start finds nothing new
        ST.ingest_sessions(stream(), out, check).awaitTermination()
    got = key(spark.read.parquet(out).select("usuario_id", "jogo_id", "inicio", "plataforma"))
    assert got == [(1, 5, day(0) - dt.timedelta(minutes=30), "PC"), (2, 6, day(0, 1), "PC")]


def test_late_rows_are_dropped_after_the_watermark(spark, folder):
    put, stream, tmp = folder
    out, check = str(tmp / "out"), str(tmp / "check")
    put("a", [(1, 1, 5, 1.0, day(0)), (2, 1, 5, 1.0, day(9))])
    ST.run_append(ST.trending_stream(stream(), 1), out, check)
    put("b", [(3, 1, 5, 1.0, day(0)), (4, 1, 6, 1.0, day(9)), (5, 1, 6, 1.0, day(20))])
    ST.run_append(ST.trending_stream(stream(), 1), out, check)
    got = key(spark.read.parquet(out).select("inicio", "jogo_id", "acessos"))
    assert got == [(day(0, 0), 5, 1), (day(9, 0), 5, 1), (day(9, 0), 6, 1)]


def test_running_engagement_equals_the_batch(spark, folder):
    put, stream, tmp = folder
    rows = [(i, i % 3, i % 5, float(i), day(i % 7)) for i in range(60)]
    put("a", rows[:20])
    put("b", rows[20:45])
    put("c", rows[45:])
    check = str(tmp / "check")
    ST.run_engagement(stream(), check)
    got = key(ST.current_engagement(spark, check))
    assert got == key(ST.engagement_stream(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(p.name for p in tmp.iterdir()) == ["check", "in"]  # nothing is written for a batch


def test_engagement_goes_on_after_a_restart(spark, folder):
    put, stream, tmp = folder
    rows = [(i, i % 4 if i % 2 else 1, 5, float(i) / 8, day(i % 9)) for i in range(80)]
    check = str(tmp / "check")
    for n in range(4):
        put(f"part{n}", rows[20 * n : 20 * n + 20])
        ST.run_engagement(stream(), check)
        so_far = spark.createDataFrame(rows[: 20 * n + 20], SCHEMA)
        assert key(ST.current_engagement(spark, check)) == key(ST.engagement_stream(so_far))
    ST.run_engagement(stream(), check)  # nothing new
    assert key(ST.current_engagement(spark, check)) == key(ST.engagement_stream(spark.createDataFrame(rows, SCHEMA)))


def test_a_very_late_repeat_is_dropped(spark, folder):
    put, stream, tmp = folder
    out, check = str(tmp / "out"), str(tmp / "check")
    put("a", [(1, 1, 5, 30.0, day(0))])
    ST.ingest_sessions(stream(), out, check).awaitTermination()
    put("b", [(2, 1, 5, 30.0, day(400))])
    ST.ingest_sessions(stream(), out, check).awaitTermination()
    put("c", [(1, 1, 5, 30.0, day(401)), (2, 1, 5, 30.0, day(800)), (3, 1, 5, 30.0, day(2))])
    ST.ingest_sessions(stream(), out, check).awaitTermination()
    assert [r["fim"] for r in spark.read.parquet(out).orderBy("fim").collect()] == [day(0), day(2), day(400)]
    other, mark = str(tmp / "other"), str(tmp / "mark")
    for _ in range(2):  # with a bound the ledger forgets: the first id is new again long after
        ST.ingest_sessions(stream(), other, mark, "10 days").awaitTermination()
    assert spark.read.parquet(other).count() >= 3
