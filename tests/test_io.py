"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from quillmere.sources import tables as T
from quillmere.streaming import windows as S


def test_partitioned_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, n int, v double")
    path = str(tmp_path / "t")
    T.write_partitioned(rows, path, ["k"])
    T.write_partitioned(rows.withColumn("v", F.col("v") + 10).union(spark.createDataFrame([("c", 3, 3.0)], rows.schema)), path, ["k"], skip_existing=spark.read.parquet(path))
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1.0), ("b", 2.0), ("c", 3.0)}
    assert T.read_many(spark, path, path, columns=["n", "v"]).count() == 6


def test_pairs_are_finite(spark, tmp_path):
    rows = spark.createDataFrame([("s", "test", 1, 0, 0, 1.0, 2.0), ("s", "test", 1, 0, 1, float("nan"), 2.0), ("s", "test", 1, 0, 2, 1.0, float("inf"))], "scenario string, split string, channel int, sample_idx int, timestep int, gt double, pred double")
    T.write_pairs(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_manifest_numbers_rows(spark, tmp_path):
    days = spark.createDataFrame([(u, d) for u in ("b", "a", "c") for d in (3, 1, 2)], "user_id string, date int")
    got = sorted(tuple(r) for r in T.sample_manifest(days, str(tmp_path / "m")).collect())
    assert got == [(i, u, d) for i, (u, d) in enumerate((u, d) for u in "abc" for d in (1, 2, 3))]


def test_json(spark, tmp_path):
    (tmp_path / "series.json").write_text(json.dumps({"mood": {"u1": {"timestamps": ["2024-01-01T00:00:00", "2024-01-02T00:00:00"], "values": ["1", "2"]}}}))
    assert [(r.label, r.user_id, r.value) for r in T.read_label_series(spark, str(tmp_path / "series.json")).orderBy("ts").collect()] == [("mood", "u1", "1"), ("mood", "u1", "2")]
    (tmp_path / "splits.json").write_text(json.dumps({"train": ["a"], "validation": [], "test": ["b"]}))
    assert {(r.user_id, r.split) for r in T.read_splits(spark, str(tmp_path / "splits.json")).collect()} == {("a", "train"), ("b", "test")}
    (tmp_path / "bad.json").write_text(json.dumps({"train": ["a"], "validation": ["a"], "test": []}))
    try:
        T.read_splits(spark, str(tmp_path / "bad.json"))
    except ValueError:
        pass
    else:
        raise AssertionError("an overlap must fail")


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    source = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(source)
    stream = S.event_stream(spark, source, events.schema)
    for name, make in (("tumbling", lambda e: S.tumbling(e, "6 hours", ["event_type"], "60 days")), ("sessions", lambda e: S.sessions(e, "4 hours", ["user_id"], "60 days"))):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
        if name == "sessions":
            query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
        query.start().awaitTermination()
        key = lambda rows: sorted(tuple(str(round(x, 4)) if isinstance(x, float) else str(x) for x in r) for r in rows)
        assert key(spark.table(name).collect()) == key(make(events).collect())


def test_stream_resumes(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(5).withColumn("value", F.col("id") * 1.0)
    rows.write.parquet(source)
    S.run_once(S.event_stream(spark, source, rows.schema), sink, mark)
    rows.write.mode("append").parquet(source)
    S.run_once(S.event_stream(spark, source, rows.schema), sink, mark)
    assert spark.read.parquet(sink).count() == 10


def test_masks_by_folder(spark, tmp_path):
    path = str(tmp_path / "masks")
    rows = lambda split, scenario, n: spark.range(n).selectExpr("id AS cell", f"'{split}' AS split", f"'{scenario}' AS scenario")
    T.write_masks(rows("test", "a", 3).union(rows("train", "a", 4)), path)
    T.write_masks(rows("test", "b", 5), path)
    assert [T.read_masks(spark, path, *x).count() for x in ((), ("test",), ("test", "b"), (None, "a"))] == [12, 8, 5, 7]


def test_window_index_and_predictions(spark, tmp_path):
    T.write_window_index(spark.sql("SELECT 1 AS u, array(0, 2) AS day_offsets, double('NaN') AS share"), str(tmp_path / "w"))
    assert tuple(spark.read.parquet(str(tmp_path / "w")).first()) == (1, [0, 2], None)
    rows = spark.createDataFrame([("b", 1.0, 0.5), ("a", 0.0, 0.49)], "user_id string, y_true double, prediction double")
    T.write_task_predictions(rows, str(tmp_path / "p"), "binary")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 0.0, 0.0, 0.49), ("b", 1.0, 1.0, 0.5)}


def test_result_csv(spark, tmp_path):
    (tmp_path / "many.csv").write_text("k,v\na,1\n")
    read = lambda: [tuple(r) for r in T.read_result_csv(spark, str(tmp_path), {"k": "string", "v": "int"}).collect()]
    assert read() == [("a", 1)]
    (tmp_path / "eval_my.csv").write_text("k,v\nb,2\n")
    assert read() == [("b", 2)]


def test_all_nullable(spark):
    kind = spark.sql("SELECT named_struct('a', array(1), 'b', map('x', 2)) AS s").schema
    assert "False" not in str(T.all_nullable(kind))
