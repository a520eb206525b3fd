"""Contracts for methods that users bring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import contracts as K


def test_data_spec():
    assert K.DataSpec("minute", "day").steps == 1440 and K.DataSpec("hour", "week").steps == 168
    with pytest.raises(ValueError):
        K.DataSpec("minute", "week")


def test_only_declared_arguments():
    assert K.declared(lambda x, sample_ids: 0, {"sample_ids": 1, "window": 2}) == {"sample_ids": 1}
    assert K.declared(lambda x, **more: 0, {"a": 1}) == {"a": 1}


def test_forecast_output():
    point, quantiles = K.forecast_output([1, 2], 2)
    assert quantiles.tolist() == [[1], [2]]
    assert K.forecast_output(([1, 2], [[0, 1, 2], [1, 2, 3]]), 2, [0.1, 0.5, 0.9])[1].shape == (2, 3)
    for bad in ([1], ([1, 2], [[1, 2]])):
        with pytest.raises(ValueError):
            K.forecast_output(bad, 2)


class _Mean:
    def fit(self, labels, task_type):
        self.shift, self.kind = labels["y"].mean(), task_type

    def predict(self, frame):
        return frame["v"].mean() + self.shift


def test_predict_users(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0)], "u string, t int, v double")
    labels = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "u string, y double")
    got = K.predict_users(_Mean(), rows, "u", ["t"], labels, "regression")
    assert {tuple(r) for r in got.collect()} == {("a", 17.0), ("b", 20.0)}
    with pytest.raises(TypeError):
        K.predict_users(object(), rows, "u", ["t"])
    with pytest.raises(ValueError):
        K.predict_users(_Mean(), rows, "u", ["t"], labels, most_labels=1)


def test_registry_and_masks(spark):
    methods = K.Registry("method")
    methods.register("mean")(lambda window=3: window)
    assert methods.build("mean", window=5, other=1) == 5
    with pytest.raises(KeyError):
        methods.build("median")
    with pytest.raises(ValueError):
        methods.register("mean")(dict)

    class Even:
        name, is_structural = "even", False

        def generate(self, cells):
            return cells.where("t % 2 = 0").select("t")

    assert {r.t for r in K.masked_cells(Even(), spark.range(5).select(F.col("id").alias("t"), F.lit(1).alias("v")), ["t"]).collect()} == {0, 2, 4}
    with pytest.raises(TypeError):
        K.masked_cells(np, spark.range(1), ["id"])
