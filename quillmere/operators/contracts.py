"""What a user's own method, forecaster or mask must look like, checked before any job runs."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resolutions and windows that go together.
LEGAL = {("minute", "day"), ("hour", "day"), ("hour", "week")}


@dataclass(frozen=True)
class DataSpec:
    """What a method reads: values by minute or hour, a day or a week at a time."""

    resolution: str = "hour"
    window: str = "day"

    def __post_init__(self):
        if (self.resolution, self.window) not in LEGAL:
            raise ValueError(f"no method reads a {self.window} by {self.resolution}")

    @property
    def steps(self) -> int:
        return {"day": 1, "week": 7}[self.window] * {"minute": 1440, "hour": 24}[self.resolution]


def declared(f: Callable, offered: dict) -> dict:
    """Of the offered keyword arguments those that the function takes; all of them if it takes any."""
    params = inspect.signature(f).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in params):
        return dict(offered)
    names = {p.name for p in params if p.kind in (p.KEYWORD_ONLY, p.POSITIONAL_OR_KEYWORD)}
    return {k: v for k, v in offered.items() if k in names}


def forecast_output(got, horizon: int, levels: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(point, quantiles) of a forecaster's answer, a point or (point, quantiles); without quantiles the point is the only one."""
    point, quantiles = got if isinstance(got, tuple) and len(got) == 2 else (got, None)
    point = np.asarray(point, dtype=float)
    if point.shape != (horizon,):
        raise ValueError(f"expected {horizon} values, got shape {point.shape}")
    if quantiles is None:
        return point, point[:, None]
    quantiles = np.asarray(quantiles, dtype=float)
    if quantiles.shape[0] != horizon or quantiles.ndim != 2 or (levels is not None and quantiles.shape[1] != len(levels)):
        raise ValueError(f"expected {horizon} rows of {len(levels) if levels else 'some'} quantiles, got shape {quantiles.shape}")
    return point, quantiles


def predict_users(method, rows: DataFrame, key: str, order: list[str], labels: DataFrame | None = None, task_type: str | None = None, most_labels: int = 100_000) -> DataFrame:
    """One prediction for each user by an object with predict(frame) and, if it has one, fit(labels[, task_type]).

    fit sees the labelled users on the driver, so their number is bounded: over most_labels rows are an error. predict runs
    on the executors, a user's rows at a time; what it returns must be one number.
    """
    if not callable(getattr(method, "predict", None)):
        raise TypeError("a method has predict(data)")
    if labels is not None and callable(getattr(method, "fit", None)):
        given = labels.limit(most_labels + 1).toPandas()
        if len(given) > most_labels:
            raise ValueError(f"over {most_labels} labelled rows; sample them first")
        method.fit(given, **declared(method.fit, {"task_type": task_type}))
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = np.asarray(method.predict(pdf.sort_values(order).reset_index(drop=True)), dtype=float)
        if got.size != 1:
            raise ValueError(f"predict gives one number for a user, not shape {got.shape}")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "prediction": [float(got.reshape(-1)[0])]})

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, prediction double")


class Registry:
    """Builders by name; a name is given once."""

    def __init__(self, what: str):
        self.what, self.builders = what, {}

    def register(self, name: str):
        def add(builder):
            if name in self.builders:
                raise ValueError(f"{self.what} {name!r} is registered already")
            self.builders[name] = builder
            return builder

        return add

    def build(self, name: str, **options):
        if name not in self.builders:
            raise KeyError(f"no {self.what} {name!r}; there are {', '.join(sorted(self.builders)) or 'none'}")
        return self.builders[name](**declared(self.builders[name], options))


def masked_cells(generator, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells a mask generator hides: an object with name, is_structural and generate(cells), which returns rows of keys."""
    for attribute in ("name", "is_structural", "generate"):
        if not hasattr(generator, attribute):
            raise TypeError(f"a mask generator has {attribute}")
    got = generator.generate(cells)
    missing = [k for k in keys if k not in got.columns]
    if missing:
        raise ValueError(f"{generator.name}: the mask lacks {', '.join(missing)}")
    hidden = got.select(*keys).distinct().withColumn("scenario", F.lit(generator.name))
    return cells.join(hidden, keys, "left_semi").withColumn("scenario", F.lit(generator.name))
