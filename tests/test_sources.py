import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from acervo.operators.profile import price_profile, temporal_split_counts
from acervo.sources import tables as T


def key(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all'), (2, "two\nlines"), (3, None)], "AppID bigint, About string")
    T.write_csv(df, str(tmp_path / "c"))
    back = T.read_catalog_csv(spark, str(tmp_path / "c"), "AppID bigint, About string")
    assert {r["AppID"]: r["About"] for r in back.collect()} == {1: 'say "hi", all', 2: "two\nlines", 3: None}


def test_splits_reload_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    T.write_splits(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]
    assert key(T.read_training_set(spark, str(tmp_path / "s")).select("id", "split")) == key(df)
    T.reload(df, str(tmp_path / "r"))
    T.reload(df.limit(1), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    v = str(tmp_path / "v")
    assert [T.write_version(df, v), T.write_version(df, v), T.next_version(spark, v)] == [1, 2, 3]
    assert T.materialize(df, str(tmp_path / "m")).count() == 3


@pytest.mark.parametrize("block", [700, 4000, 1 << 20])
def test_one_csv_file_in_many_ranges(spark, tmp_path, block):
    import random

    from acervo.sources.csv_rows import read_quoted_csv

    rng = random.Random(block)
    text = lambda: "".join(rng.choices(['a', 'é', ',', '"', '\n', '\r\n', ' b ', '\n\n"'], k=rng.choice([0, 3, 40, 900])))
    rows = [(i, text() or None, rng.choice([None, "x", 'q"']), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "AppID bigint, About string, t string, p double")
    T.write_csv(df.coalesce(1), str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        back = read_quoted_csv(spark, str(tmp_path / "c"), df.schema)
        got = key(back.na.fill("-"))
        tasks = spark.read.text(str(tmp_path / "c")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = spark.read.schema(df.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert got == key(plain.na.fill("-")) == key(df.na.fill("-"))
    assert block > 4000 or tasks > 10


def test_csv_odd_files(spark, tmp_path):
    from acervo.sources.csv_rows import read_quoted_csv

    for name, body in {"a.csv": 'x,"y\nz"\r\n1,"one\r\ntwo"\r\n\r\n2,\r\n', "b.csv": "x,y\n3,last", "c.csv": "", "d.csv": "x,y\n"}.items():
        (tmp_path / name).write_bytes(body.encode())
    got = {r["x"]: r["y"] for r in read_quoted_csv(spark, str(tmp_path), "x int, y string").collect()}
    assert got == {1: "one\r\ntwo", 2: None, 3: "last"}


def test_two_writers_get_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from acervo.sources import versions as V

    path = str(tmp_path / "v")
    frames = [spark.createDataFrame([(i, j) for j in range(5)], "w int, j int") for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda df: V.write_version(df, path), frames))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6] == V.finished_versions(spark, path)
    for i, n in enumerate(numbers):
        assert key(V.read_version(spark, path, n)) == [(i, j) for j in range(5)]
    assert spark.read.parquet(path).count() == 30


def test_a_lost_writer_is_never_read(spark, tmp_path):
    from acervo.sources import versions as V

    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, path)
    assert V.claim_version(spark, path) == 1
    spark.range(3).write.parquet(f"{path}/_writing-1")  # and then the writer dies
    assert V.finished_versions(spark, path) == []
    assert V.write_version(spark.range(2), path) == 2
    assert V.read_version(spark, path).count() == 2 == spark.read.parquet(path).count()
    with pytest.raises(FileNotFoundError):
        V.read_version(spark, path, 1)


@pytest.mark.parametrize("cuts", [[0, 400], [0, 1, 2, 399, 400], [0, 0, 150, 151, 400]])
def test_summary_by_batches_is_the_whole_summary(spark, tmp_path, cuts):
    import random

    from acervo.sources import summary as SU

    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None, f"k{i}"]), rng.choice([None, 1e9 + rng.random(), rng.random()])) for i in range(400)]
    df = lambda part: spark.createDataFrame(part, "k string, v double")
    path = str(tmp_path / "s")
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2):  # a refresh that runs again changes nothing
            version = SU.refresh_summary(df(rows[a:b]), path, ["k"], "v", f"b{n}")
        assert version == n + 1
    got = {r["k"]: r for r in SU.read_summary(spark, path, ["k"]).collect()}
    want = {r["k"]: r for r in SU.summary_of(SU.value_states(df(rows), ["k"], "v"), ["k"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k]["total"], got[k]["menor"], got[k]["maior"]) == (w["total"], w["menor"], w["maior"])
        for c in ("media", "desvio"):
            assert got[k][c] == (pytest.approx(w[c], rel=1e-9) if w[c] is not None else None)
    assert SU.batches_in(spark, path) == [f"b{n}" for n in range(len(cuts) - 1)]


def test_profile_json(spark, tmp_path):
    df = spark.createDataFrame([(5.0, "a,b", "2017-01-01"), (7.0, "a", "2019-05-05"), (9.0, None, None)], "Price double, Genres string, d string").withColumn("Release date", F.to_timestamp("d").cast("timestamp_ntz"))
    T.write_profile_json(T.catalog_profile(df, temporal_split_counts(df, "Release date"), price_profile(df)), str(tmp_path / "p"))
    got = json.loads(spark.read.text(str(tmp_path / "p")).first()[0])
    assert got["temporal_split_sizes"] == {"treino": 1, "validacao": 1, "teste": 0}
    assert got["price_stats"] == {"mean": 7.0, "std": 2.0, "median": 7.0}
    assert got["top_genres"] == [{"genero": "a", "n": 2}, {"genero": "b", "n": 1}]


def test_insert_ignore_and_upsert(spark):
    have = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, t string, p double")
    new = spark.createDataFrame([(2, "B", 9.0), (3, "C", 3.0)], "id int, t string, p double")
    assert key(T.insert_ignore(have, new.unionByName(new), ["id"])) == [(3, "C", 3.0)]
    assert key(T.upsert(have, new, ["id"], ["t"])) == [(1, "a", 1.0), (2, "B", 2.0), (3, "C", 3.0)]
    gone = spark.createDataFrame([(1, None, 5.0)], "id int, t string, p double")
    assert key(T.upsert(have, gone, ["id"], ["t"]).where("id = 1 AND t IS NULL"))[0][2] == 1.0  # a new null counts


def test_append_sessions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(1, 2, 90.0, at, "Deck"), (1, 2, 0.0, at, "PC"), (1, 2, 5.0, at, "x" * 51), (1, 3, 1.5, at, None)]
    df = spark.createDataFrame(rows, "usuario_id int, jogo_id int, minutos double, fim timestamp_ntz, plataforma string")
    T.append_sessions(df, str(tmp_path / "a"))
    T.append_sessions(df.drop("plataforma").limit(1), str(tmp_path / "a"))
    got = key(spark.read.parquet(str(tmp_path / "a")).select("jogo_id", "inicio", "plataforma"))
    assert got == [(2, at - dt.timedelta(minutes=90), "Deck"), (2, at - dt.timedelta(minutes=90), "PC"), (3, at - dt.timedelta(seconds=90), "PC")]


def test_rows_to_json(spark):
    df = spark.createDataFrame([(1, "ç"), (2, None)], "a int, b string")
    assert sorted(r["json"] for r in T.to_json_rows(df).collect()) == ['{"a":1,"b":"ç"}', '{"a":2}']


def test_scan_reads_few_columns_and_pushes_the_filter(spark, sf):
    from acervo.operators.market import game_by_id
    from acervo.plans import bindings as B

    users = B.users(spark, sf)
    plan = game_by_id(users, 7)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(c_custkey,7)" in plan and "c_acctbal" not in plan


def test_shared_folder_comes_from_the_session(spark):
    from acervo.session import scratch, shared_root

    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(shared_root(spark)) and scratch(spark, "x") != scratch(spark, "x")
