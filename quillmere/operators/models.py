"""Models: probes on pyspark.ml, small statistical forecasters, and contracts for models that users bring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, Normalizer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# -- probes


def _stages(column: str, width: int, robust: bool, unit: bool, components: int | None) -> tuple[list, str]:
    stages, at = [], column
    if robust:
        stages.append(RobustScaler(inputCol=at, outputCol="_robust", withCentering=True))
        at = "_robust"
    else:
        stages.append(StandardScaler(inputCol=at, outputCol="_scaled", withMean=True, withStd=True))
        at = "_scaled"
    if unit:
        stages.append(Normalizer(inputCol=at, outputCol="_unit", p=2.0))
        at = "_unit"
    if components:
        stages.append(PCA(k=min(components, width), inputCol=at, outputCol="_pca"))
        at = "_pca"
    return stages, at


def linear_probe(train: DataFrame, test: DataFrame, features: str, label: str, kind: str, robust: bool = False, unit: bool = False, components: int | None = None, reg: float = 0.01) -> DataFrame:
    """Predictions for `test` of a linear model over an array column: binary gives a probability, regression a value.

    ordinal fits a model per threshold between levels and predicts the level's index with most probability. Missing
    features are 0; rows without a label do not train.
    """
    def vectors(frame):
        return frame.withColumn("_v", array_to_vector(F.transform(features, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))))

    known = vectors(train.where(F.col(label).isNotNull()))
    width = known.select(F.size(features)).first()
    if width is None:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    stages, at = _stages("_v", width[0], robust, unit, components)
    scaler = Pipeline(stages=stages).fit(known)
    a, b = scaler.transform(known), scaler.transform(vectors(test))
    drop = [c for c in b.columns if c.startswith("_")]
    if kind == "regression":
        model = LinearRegression(featuresCol=at, labelCol=label, predictionCol="prediction", regParam=reg, solver="normal" if width[0] <= 512 else "auto").fit(a.withColumn(label, F.col(label).cast("double")))
        return model.transform(b).drop(*drop)
    if kind == "binary":
        return _binary(a.withColumn(label, F.col(label).cast("double")), b, at, label, reg, "prediction").drop(*drop)
    if kind != "ordinal":
        raise ValueError(f"unknown kind {kind!r}")
    levels = sorted(r[0] for r in known.select(label).distinct().limit(101).collect())
    if len(levels) > 100:
        raise ValueError("an ordinal label has up to 100 levels")
    over = []
    for i, level in enumerate(levels[:-1]):
        b = _binary(a.withColumn("_y", (F.col(label) > level).cast("double")), b, at, "_y", reg, f"_over{i}")
        over.append(F.col(f"_over{i}"))
    edges = [F.lit(1.0), *over, F.lit(0.0)]
    shares = F.array(*[hi - lo for hi, lo in zip(edges, edges[1:])])
    return b.withColumn("prediction", (F.array_position(shares, F.array_max(shares)) - 1).cast("double")).drop(*drop, *[f"_over{i}" for i in range(len(over))])


def _binary(train: DataFrame, test: DataFrame, at: str, label: str, reg: float, out: str) -> DataFrame:
    model = LogisticRegression(featuresCol=at, labelCol=label, regParam=reg, maxIter=50, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_hard").fit(train)
    return model.transform(test).withColumn(out, vector_to_array("_prob")[1]).drop("_prob", "_raw", "_hard")


def tree_probe(train: DataFrame, test: DataFrame, features: str, label: str, kind: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42) -> DataFrame:
    """Predictions for `test` of boosted trees over an array column: binary gives a probability, regression a value.

    Missing features are a value of their own below all others. Rows without a label do not train; without any the
    prediction is NULL.
    """
    if kind not in ("binary", "regression"):
        raise ValueError(f"unknown kind {kind!r}")
    low = F.lit(-1e30)
    vectors = lambda frame: frame.withColumn("_v", array_to_vector(F.transform(features, lambda x: F.coalesce(F.nanvl(x.cast("double"), low), low))))
    known = vectors(train.where(F.col(label).isNotNull())).withColumn("_y", F.col(label).cast("double"))
    if known.first() is None:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    common = {"featuresCol": "_v", "labelCol": "_y", "maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
    if kind == "regression":
        return GBTRegressor(**common, predictionCol="prediction").fit(known).transform(vectors(test)).drop("_v")
    model = GBTClassifier(**common, predictionCol="_hard").setProbabilityCol("_prob").setRawPredictionCol("_raw").fit(known)
    return model.transform(vectors(test)).withColumn("prediction", vector_to_array("_prob")[1]).drop("_v", "_prob", "_raw", "_hard")


def functional_components(profiles: DataFrame, key: list[str], column: str, k: int = 4) -> DataFrame:
    """Scores of day profiles on their principal components; a component's largest loading is positive."""
    v = profiles.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    mean = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(mean)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    return model.transform(mean).select(*key, F.zip_with(vector_to_array("_s"), F.array(*[F.lit(s) for s in signs]), lambda a, b: a * b).alias("scores"))


# -- statistical forecasters


def holt_winters(y: np.ndarray, horizon: int, season: int, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2) -> np.ndarray:
    """Additive level, trend and season; without two full cycles no season; a constant or short series repeats its last value."""
    seen = np.isfinite(y)
    if not seen.any():
        return np.zeros(horizon)
    at = np.maximum.accumulate(np.where(seen, np.arange(len(y)), -1))
    y = np.where(at >= 0, y[np.maximum(at, 0)], y[seen.argmax()])
    if len(y) < 3 or np.ptp(y) == 0:
        return np.full(horizon, y[-1])
    cycles = len(y) >= 2 * season
    phase = np.array([y[i::season][: len(y) // season].mean() for i in range(season)]) - y[: len(y) // season * season].mean() if cycles else np.zeros(season)
    level, trend = y[0] - phase[0], 0.0
    for t in range(len(y)):
        s = phase[t % season]
        last = level
        level = alpha * (y[t] - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - last) + (1 - beta) * trend
        if cycles:
            phase[t % season] = gamma * (y[t] - level) + (1 - gamma) * s
    steps = np.arange(1, horizon + 1)
    out = level + trend * steps + phase[(len(y) + steps - 1) % season]
    return np.where(np.isfinite(out), out, y[-1])


def autoregression(y: np.ndarray, order: int = 2) -> np.ndarray:
    """Coefficients of an autoregression of first differences by conditional least squares, intercept last; NaN if too short."""
    d = np.diff(y[np.isfinite(y)])
    n = len(d) - order
    if n < order + 2 or np.ptp(d) == 0:
        return np.full(order + 1, np.nan)
    x = np.stack([d[order - 1 - j : order - 1 - j + n] for j in range(order)] + [np.ones(n)], axis=1)
    return np.linalg.lstsq(x, d[order:], rcond=None)[0]


# -- contracts for other models


def impute_with(cells: DataFrame, keys: list[str], order: str, value: str, masked: str, fill: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Predictions at masked cells by a function of (values with NaN where unknown, mask) for one series.

    What it returns must be as long as the series; where it is not finite the mean of the known cells stands in and the row is flagged.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, order]) + ", gt double, pred double, is_fallback boolean, method string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        hidden, truth = pdf[masked].to_numpy(dtype=bool), pdf[value].to_numpy(dtype=float)
        known = np.where(hidden, np.nan, truth)
        pred = np.asarray(fill(known.copy(), hidden.copy()), dtype=float)
        if pred.shape != known.shape:
            raise ValueError(f"{name}: expected {known.shape[0]} values, got shape {pred.shape}")
        bad = ~np.isfinite(pred)
        middle = float(np.nanmean(known)) if np.isfinite(known).any() else 0.0
        out = pdf[[*keys, order]].assign(gt=truth, pred=np.where(bad, middle, pred), is_fallback=bad, method=name)
        return out[hidden]

    return cells.groupBy(*keys).applyInPandas(run, schema)


def forecast_with(series: DataFrame, keys: list[str], order: str, value: str, start: str, horizon: int, predict: Callable[[np.ndarray, int], np.ndarray], name: str, season: int = 1) -> DataFrame:
    """A row per key and hour ahead by a function of (history, horizon); the history is gap-filled with NaN up to the start.

    Where its answer is not finite the value one season before stands in (that of the last season of the history, again and
    again), else the last known value, else 0, and the row is flagged.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ahead int, pred double, is_fallback boolean, method string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = int(pdf[start].iloc[0])
        past = pdf[pdf[order] < begin]
        first = int(past[order].min()) if len(past) else begin
        history = np.full(begin - first, np.nan)
        history[past[order].to_numpy(dtype=int) - first] = past[value].to_numpy(dtype=float)
        got = np.asarray(predict(history, horizon), dtype=float)
        if got.shape != (horizon,):
            raise ValueError(f"{name}: expected {horizon} values, got shape {got.shape}")
        bad = ~np.isfinite(got)
        last = history[np.isfinite(history)][-1] if np.isfinite(history).any() else 0.0
        cycle = np.full(season, np.nan)
        cycle[max(0, season - len(history)) :] = history[-season:]
        naive = np.resize(cycle, horizon)
        naive = np.where(np.isfinite(naive), naive, last)
        head = {k: [pdf[k].iloc[0]] * horizon for k in keys}
        return pd.DataFrame({**head, "ahead": np.arange(horizon, dtype="int32"), "pred": np.where(bad, naive, got), "is_fallback": bad, "method": name})

    return series.groupBy(*keys).applyInPandas(run, schema)
