"""Queries without SQL against plain numpy on the same rows."""

import numpy as np
import pandas as pd
import pytest

from quillmere.operators import models as ML
from quillmere.plans.base import cells, user_errors
from quillmere.plans.modelling import _last_value, _series
from quillmere.plans.registry import QUERIES


def test_components_are_those_of_the_svd(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT user_id, hour(ts) AS h, sum(value) AS v FROM read_parquet('{sf}/events.parquet') GROUP BY 1, 2").df()
    profile = rows.pivot(index="user_id", columns="h", values="v").reindex(columns=range(24)).fillna(0.0).sort_index()
    x = profile.to_numpy(dtype=float)
    x = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    signs = np.sign(axes[np.arange(4), np.abs(axes[:4]).argmax(axis=1)])
    want = x @ (axes[:4] * signs[:, None]).T
    got = QUERIES["profile_components"](spark, sf).toPandas().set_index("user_id").loc[profile.index, ["pc1", "pc2", "pc3", "pc4"]].to_numpy()
    assert np.allclose(got, want, atol=1e-3)


def test_smoothing_of_each_series(spark, sf):
    series = _series(spark, sf).toPandas()
    got = QUERIES["smoothing_forecast"](spark, sf).toPandas().set_index(["user_id", "channel", "ahead"]).pred
    assert len(got) == 6 * series.groupby(["user_id", "channel"]).ngroups
    for (user, channel), own in series.groupby(["user_id", "channel"]):
        past = own[own.step < 24].set_index("step").v
        history = past.reindex(range(int(past.index.min()), 24)).to_numpy() if len(past) else np.array([])
        want = ML.holt_winters(history, 6, 7)
        assert np.allclose([got[user, channel, k] for k in range(6)], want, atol=1e-3)


def test_forecasts_fall_back_by_season(spark):
    t = pd.DataFrame({"u": ["a"] * 5 + ["b"], "i": [0, 1, 2, 3, 5, 9], "v": [9.0, 8.0, 1.0, 2.0, 4.0, 1.0], "start": [6] * 6})
    nothing = ML.forecast_with(spark.createDataFrame(t), ["u"], "i", "v", "start", 5, lambda y, h: np.array([7.0] + [np.nan] * (h - 1)), "mine", 3).toPandas().sort_values(["u", "ahead"])
    assert nothing.pred.tolist() == [7.0, 4.0, 4.0, 2.0, 4.0, 7.0, 0.0, 0.0, 0.0, 0.0]  # steps 3 to 5 are 2, unknown and 4
    assert nothing.is_fallback.tolist() == [False, True, True, True, True] * 2


def test_own_imputer_beside_the_built_in_ones(spark, sf):
    rows = []
    for (user, channel), own in cells(spark, sf).toPandas().sort_values("hour_idx").groupby(["user_id", "channel"]):
        hidden, truth = own.masked.to_numpy(dtype=bool), own.v.to_numpy(dtype=float)
        pred = _last_value(np.where(hidden, np.nan, truth), hidden)
        if hidden.any():
            rows.append(("mine", channel, user, np.abs(truth - np.where(np.isfinite(pred), pred, 0.0))[hidden].mean()))
    errors = pd.concat([user_errors(spark, sf).toPandas(), pd.DataFrame(rows, columns=["method", "channel", "user_id", "e"])])
    base = errors[errors.method == "locf"].set_index(["channel", "user_id"]).e.rename("b")
    paired = errors.join(base, on=["channel", "user_id"])
    paired = paired[(paired.b > 0) & (paired.method != "locf")]
    logs = np.log((paired.e / paired.b).clip(0.01, 100)).groupby([paired.method, paired.channel]).mean()
    want = 1 - np.exp(logs.groupby(level=0).mean())
    got = QUERIES["evaluate_imputation"](spark, sf).toPandas().set_index("method")
    for method in want.index:
        assert got.skill[method] == pytest.approx(want[method], abs=1e-5)
    assert got.mean_rank.sum() == pytest.approx(15)


def test_intervals_hold_the_mean_of_users(spark, sf):
    errors = user_errors(spark, sf).toPandas()
    want = errors.groupby(["method", "user_id"]).e.mean().groupby(level=0).mean()
    got = QUERIES["bca_interval"](spark, sf).toPandas().set_index("method")
    assert np.allclose(got.estimate.loc[want.index], want, atol=1e-5)
    assert ((got.low < got.estimate) & (got.estimate < got.high)).all()


def test_results_do_not_overwrite(spark, sf, tmp_path):
    from quillmere import api

    got = api.evaluate_imputation(cells(spark, sf))
    got.to_csv(str(tmp_path / "r"))
    with pytest.raises(Exception, match="already exists"):
        got.to_csv(str(tmp_path / "r"))
    got.to_csv(str(tmp_path / "r"), mode="overwrite")


def test_own_forecaster_against_the_seasonal_one(spark, sf):
    rows = []
    for (user, channel), own in _series(spark, sf).toPandas().groupby(["user_id", "channel"]):
        values = own.set_index("step").v
        past, truth = values[values.index < 24], values[(values.index >= 24) & (values.index < 30)]
        if not len(truth):
            continue
        history = past.reindex(range(int(past.index.min()), 24)).to_numpy() if len(past) else np.array([])
        mean = past.mean() if len(past) else 0.0
        same = lambda k: past[[s for s in past.index if s >= 24 - 49 and (s - 24 - k) % 7 == 0]].sort_index()
        naive = {k: same(k).iloc[-1] if len(same(k)) else mean for k in range(6)}
        own_way = ML.holt_winters(history, 6, 7)
        for method, pred in (("seasonal_naive", naive), ("smoothing", own_way)):
            rows.append((method, channel, user, np.mean([abs(v - pred[s - 24]) for s, v in truth.items()])))
    errors = pd.DataFrame(rows, columns=["method", "channel", "user_id", "e"]).set_index(["method", "channel", "user_id"]).e
    base = errors["seasonal_naive"]
    ratio = (errors["smoothing"][base > 0] / base[base > 0]).clip(0.01, 100)
    want = 1 - np.exp(np.log(ratio).groupby("channel").mean().mean())
    got = QUERIES["evaluate_forecasting"](spark, sf).toPandas().set_index("method")
    assert got.skill["smoothing"] == pytest.approx(want, abs=1e-5)
    assert got.mean_rank.sum() == pytest.approx(3)
