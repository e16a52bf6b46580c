import datetime as dt

from pyspark.sql import functions as F

from cairnlight.sources import io
from cairnlight.streaming.incremental import IncrementalLatest, IncrementalMin, sessions, windowed_counts


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,1", 'quo"te', ""), ("b", "line\nbreak", "é")], "x string, y string, z string")
    io.write_csv_text(df, str(tmp_path / "c"), one_file=True)
    assert sorted(map(tuple, io.read_csv_text(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, df.collect()))


def test_jsonl_and_validation(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "t": "x"}\n\n{"id": "a", "t": ""}\n{"id": " ", "t": "y"}\n')
    df = io.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id string, t string")
    assert df.count() == 3
    assert sorted(r.problem for r in io.validated(df, "id", ["t"]).collect()) == ["blank id", "blank t", "repeated id"]


def test_json_map(spark):
    df = spark.createDataFrame([('{"p1": {"code": "7", "cutoff": "2024-01-01"}, "p2": {"code": "8"}}',)], "j string")
    got = sorted(map(tuple, io.json_map_rows(df, "j", "struct<code: string, cutoff: string>", "pid").collect()), key=str)
    assert got == [("p1", "7", "2024-01-01"), ("p2", "8", None)]


def test_documents_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    got = {r.title: r.text for r in io.read_documents(spark, str(tmp_path), "text", pattern="a*").collect()}
    assert got == {"a.txt": "one\ntwo"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "d.json").write_text('[{"text": "x", "name": "n"}]')
    assert io.read_documents(spark, str(tmp_path / "j"), "json", title="name").first().title == "n"


def test_notes(spark):
    text = "Name: X\n\n2024-01-02\nfirst\n2024-01-03 is not a day line\n\n2024-02-01\nsecond\n"
    df = spark.createDataFrame([(1, text), (2, "2024-05-05\nonly")], "id int, t string")
    got = [(r.id, str(r.day)) for r in io.note_entries(df, "id", "t").orderBy("id", "place").collect()]
    assert got == [(1, "None"), (1, "2024-01-02"), (1, "2024-02-01"), (2, "2024-05-05")]


def test_store_and_vectors(spark, tmp_path):
    store = io.Store(spark, str(tmp_path))
    store.set("t", spark.range(3))
    assert store.has("t") and store.backup(["t"]).get("t").count() == 3
    store.delete("t")
    assert not store.has("t")
    v = io.VectorStore(spark, str(tmp_path / "v"))
    v.load(spark.createDataFrame([("a", "A", [1.0, 0.0], "{}"), ("b", "B", [0.0, 1.0], "{}"), ("z", "Z", [0.0, 0.0], "{}")], "id string, text string, vector array<float>, attributes string"))
    v.load(spark.createDataFrame([("c", "C", [1.0, 1.0], "{}")], "id string, text string, vector array<float>, attributes string"), overwrite=False)
    assert [r.id for r in v.search([1.0, 0.1], 2).collect()] == ["a", "c"]
    assert [r.id for r in v.search([1.0, 0.1], 2, ["b"]).collect()] == ["b"]


def test_keyed_log(spark, tmp_path):
    log = io.KeyedLog(spark, str(tmp_path / "log"), ["k"])
    make = lambda df: df.withColumn("revision", F.lit(1)).withColumn("v", F.upper("k"))
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    assert log.compute(wanted, make).count() == 2
    log.save(spark.createDataFrame([("a", 2, "new")], "k string, revision int, v string"))
    assert {r.k: r.v for r in log.latest().collect()} == {"a": "new", "b": "B"}
    assert log.missing(spark.createDataFrame([("c",), ("a",)], "k string")).collect()[0].k == "c"


def test_incremental_equals_batch(spark, tmp_path):
    rows = [("u1", i, i % 3) for i in range(9)] + [("u2", 4, 0)]
    schema = "u string, day int, kind int"
    for i, part in enumerate((rows[6:], rows[:3], rows[3:6])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    inc = IncrementalMin(io.Store(spark, str(tmp_path / "state")), "u", "day", F.col("kind") == 1)
    q = inc.start(stream, str(tmp_path / "check"))
    q.awaitTermination(120)
    last = q.lastProgress["batchId"]
    batch = spark.createDataFrame(rows, schema).filter("kind = 1").groupBy("u").agg(F.min("day").alias("cutoff"))
    assert sorted(map(tuple, inc.state(last).collect())) == sorted(map(tuple, batch.collect()))
    latest = IncrementalLatest(io.Store(spark, str(tmp_path / "latest")), ["u"], ["day"], ["kind"])
    for n, part in enumerate((rows[:5], rows[5:])):
        latest.update(spark.createDataFrame(part, schema), n)
        latest.update(spark.createDataFrame(part, schema), n)  # a batch that is run again changes nothing
    assert sorted(map(tuple, latest.state(1).collect())) == [("u1", 8, 2), ("u2", 4, 0)]


def test_windows_and_sessions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, 1.0), ("a", t + dt.timedelta(minutes=50), 2.0), ("a", t + dt.timedelta(minutes=70), 4.0), ("b", t, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = sorted((r.k, r.n, r.total) for r in windowed_counts(df, "ts", ["k"], "v").collect())
    assert got == [("a", 1, 4.0), ("a", 2, 3.0), ("b", 1, 1.0)]
    assert sorted((r.k, r.n) for r in sessions(df, "ts", "k").collect()) == [("a", 1), ("a", 2), ("b", 1)]
