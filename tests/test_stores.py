"""Arrow streams, folders of splits, keys in paths, caches, sidecars, state and sinks of streams, window operators."""

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.operators import windows as W
from quillmere.sources import stores as S
from quillmere.streaming import state, windows


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def stream(path, **columns):
    table = pa.table(columns)
    with pa.OSFile(str(path), "wb") as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=2)


def test_arrow_streams(spark, tmp_path):
    kind = T.StructType([T.StructField("u", T.StringType()), T.StructField("v", T.DoubleType())])
    with pytest.raises(FileNotFoundError):
        S.read_arrow_streams(spark, str(tmp_path), kind)
    stream(tmp_path / "data-0.arrow", u=["a", "b", None], v=[1, 2, 3], more=[0, 0, 0])
    stream(tmp_path / "data-1.arrow", u=["c"])
    whole = rows(S.read_arrow_streams(spark, str(tmp_path), kind, "test"), "u", "v")
    assert whole == sorted([("a", 1.0), ("b", 2.0), (None, 3.0), ("c", None)], key=str)
    (tmp_path / "test").mkdir()
    stream(tmp_path / "test" / "x.arrow", u=["t"], v=[9.0])
    assert rows(S.read_arrow_streams(spark, str(tmp_path), kind, "test"), "u", "v") == [("t", 9.0)]


def test_folders_of_splits(spark, tmp_path):
    spark.sql("SELECT 1 AS a").write.parquet(str(tmp_path / "d" / "train"))
    spark.sql("SELECT 2 AS a, 'x' AS b").write.parquet(str(tmp_path / "d" / "test"))
    assert rows(S.read_splits_folder(spark, str(tmp_path / "d")), "a", "b", "split") == [(1, None, "train"), (2, "x", "test")]
    assert rows(S.read_splits_folder(spark, str(tmp_path / "d"), ["test"]), "a") == [(2,)]
    assert rows(S.read_splits_folder(spark, str(tmp_path / "d" / "train")), "a", "split") == [(1, None)]


def test_keys_in_paths(spark, tmp_path):
    import pyarrow.parquet as pq

    for model, user in (("m", "u 1"), ("m", "u2"), ("n", "u2")):
        (tmp_path / model / "mae").mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"v": [1.0]}), tmp_path / model / "mae" / f"{user}.parquet")
    got = rows(S.read_by_path(spark, str(tmp_path), ["model", "metric", "user"]), "model", "metric", "user", "v")
    assert got == [("m", "mae", "u 1", 1.0), ("m", "mae", "u2", 1.0), ("n", "mae", "u2", 1.0)]


def test_days_in_one_form(spark):
    got = S.normalise_days(spark.sql("SELECT array(array(1, 2), array(3, null)) AS values"), 2, 3).first()
    assert (got["data"], got["nonwear"]) == ([[1.0, 2.0], [3.0, None]], [0.0, 0.0, 0.0])
    assert S.normalise_days(spark.sql("SELECT array(array(1)) AS data, array(5) AS nonwear"), 1, 3).first()["nonwear"] == [5.0]
    with pytest.raises(Exception, match="expected 2 channels, found 1"):
        S.normalise_days(spark.sql("SELECT array(array(1)) AS values"), 2, 3).collect()


def test_cache_by_configuration(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5).withColumn("u", F.col("id") % 2)

    first = S.cached_table(spark, str(tmp_path), {"a": 1, "b": 2}, make, ["u"])
    again = S.cached_table(spark, str(tmp_path), {"b": 2, "a": 1}, make)
    assert first.count() == again.count() == 5 and len(made) == 1
    S.cached_table(spark, str(tmp_path), {"a": 2, "b": 2}, make)
    assert len(made) == 2
    assert S.read_meta(spark, f"{tmp_path}/{S.config_key({'a': 1, 'b': 2})}") == {"a": 1, "b": 2}


def test_sidecars(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_with_meta(spark.sql("SELECT 'm' AS method, 1.5D AS e"), path, {"draws": 10}, ["method"])
    assert S.read_meta(spark, path) == {"draws": 10, "columns": {"method": "string", "e": "double"}}
    assert S.read_meta(spark, str(tmp_path / "none")) == {}
    cells = spark.sql("SELECT * FROM VALUES ('a', true), ('a', false), ('b', false) AS t(method, is_fallback)")
    paths = [str(tmp_path / n) for n in ("x", "y")]
    for p in paths:
        S.fallback_counts(cells, ["method"]).write.json(p)
    assert rows(S.merge_fallbacks(spark, paths, ["method"]), "method", "n_fallback", "n_total", "rate") == [("a", 2, 4, 0.5), ("b", 0, 2, 0.0)]


def test_batches_of_a_split(spark):
    days = spark.sql("SELECT id AS user_id, id AS n, array(array(double('NaN'), 1D, null)) AS values FROM range(7)")
    users = spark.sql("SELECT id AS user_id, if(id < 5, 'test', 'train') AS split FROM range(7)")
    got = list(S.split_batches(days, users, "test", ["n"], 2))
    assert [[r.n for r in b] for b in got] == [[0, 1], [2, 3], [4]] and got[0][0]["mask"] == [[False, True, False]]
    assert [len(b) for b in S.split_batches(days, users, "test", ["n"], 2, 3)] == [2, 1]


def _events(spark, path, values):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    spark.createDataFrame([(u, at(s), v) for u, s, v in values], "u string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def test_state_is_given_out_and_evicted(spark, tmp_path):
    path, kind = str(tmp_path / "in"), T.StructType([T.StructField("u", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])
    for values in ([("a", 0, 1.0), ("a", 5, None), ("b", 0, 4.0)], [("b", 30, 1.0)], [("c", 1000, 1.0)], [("c", 2000, 1.0)]):
        _events(spark, path, values)
    out = state.user_totals(windows.event_stream(spark, path, kind), "u", "1 second", 60)
    windows.run_once(out, str(tmp_path / "out"), str(tmp_path / "mark"))
    got = rows(spark.read.parquet(str(tmp_path / "out")), "u", "n", "total")
    assert got[:2] == [("a", 2, 1.0), ("b", 2, 5.0)]


def test_sink_leaves_out_what_is_there(spark, tmp_path):
    path, kind = str(tmp_path / "in"), T.StructType([T.StructField("u", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    _events(spark, path, [("a", 0, 1.0), ("a", 1, 2.0)])
    state.sink_once(windows.event_stream(spark, path, kind), out, mark, "u")
    _events(spark, path, [("a", 2, 9.0), ("b", 3, 4.0)])
    state.sink_once(windows.event_stream(spark, path, kind), out, mark, "u")
    state.sink_once(windows.event_stream(spark, path, kind), out, mark, "u")
    assert rows(spark.read.parquet(out), "u", "value") == [("a", 1.0), ("a", 2.0), ("b", 4.0)]
    state.sink_once(windows.event_stream(spark, path, kind), out, str(tmp_path / "other"))  # run anew: batches overwrite their own folders
    assert spark.read.parquet(out).where("batch = 0").count() <= 4


def test_running_stats_of_a_stream(spark, tmp_path):
    path, kind = str(tmp_path / "in"), T.StructType([T.StructField("u", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])
    _events(spark, path, [("a", 0, 1.0), ("b", 1, 2.0)])
    _events(spark, path, [("a", 2, 3.0), ("a", 3, None)])
    own = windows.running_stats(windows.event_stream(spark, path, kind), "u")
    own.writeStream.format("memory").queryName("kept_up").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("kept_up"), "u", "n", "total", "squares") == [("a", 2, 4.0, 10.0), ("b", 1, 2.0, 4.0)]


def test_fill_forward(spark):
    t = spark.sql("SELECT * FROM VALUES ('a', 1, null), ('a', 2, 5D), ('a', 3, double('NaN')), ('b', 1, null), ('b', 2, null) AS t(k, i, v)")
    assert rows(W.fill_forward(t, ["k"], "i", "v"), "k", "i", "v") == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, 0.0), ("b", 2, 0.0)]


def test_stacked_ranks_count_missing_units(spark):
    t = spark.sql("SELECT * FROM VALUES ('x', 1, 1, 2D), ('y', 1, 1, 2D), ('x', 1, 2, 1D), ('y', 1, 3, null) AS t(method, task, u, e)")
    got = rows(W.stacked_ranks(t, ["x", "y"], ["task"], "u", "e"), "method", "mean_rank", "n_units", "n_ranked")
    assert got == [("x", 1.25, 3, 2), ("y", 1.5, 3, 1)]


def test_windows_fill_across_days(spark):
    t = spark.sql("SELECT * FROM VALUES ('u', 0, 'c', 1, 4D, false), ('u', 5, 'c', 121, 8D, true), ('u', 9, 'c', 217, 6D, true) AS t(u, d, ch, h, v, masked)")
    got = rows(W.impute_windows(t, t, "u", "d", "ch", "h", "v", "masked", 2), "d", "window_no", "slot", "first_day", "pred")
    assert got == [(5, 0, 1, 0, 4.0), (9, 1, 0, 9, 0.0)]
