"""What a user calls: three evaluations over tables of cells, windows or labels, and their results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.columns import tidy
from quillmere.operators import impute as I
from quillmere.operators import leaderboard as L
from quillmere.operators import metrics as M
from quillmere.operators import models as ML

SCENARIOS = ("random_noise", "temporal_slice", "signal_slice", "sleep_gap", "workout_gap", "intensity_failure")


def list_masking_scenarios() -> list[str]:
    return list(SCENARIOS)


def list_tasks(labels: DataFrame) -> list[str]:
    """A wide label table's tasks: all columns but its keys."""
    return [c for c in labels.columns if c not in ("user_id", "date", "doc_id", "split")]


class Results:
    """Tables of an evaluation: per-unit errors, skill and ranks, and fairness where subgroups were given."""

    def __init__(self, errors: DataFrame, skill: DataFrame, ranks: DataFrame, fairness: DataFrame | None = None):
        self.errors, self.skill, self.ranks, self.fairness = errors, skill, ranks, fairness

    def to_dataframe(self) -> DataFrame:
        return self.skill.join(self.ranks, [c for c in self.skill.columns if c in self.ranks.columns], "full")

    def summary(self) -> DataFrame:
        """One row per method: balanced skill over tasks and mean rank."""
        task = [c for c in self.skill.columns if c not in ("method", "skill", "ratio", "n_pairs")]
        skill = L.balanced_skill(self.skill, [["method", *task], ["method"]]).select("method", "skill")
        return skill.join(L.mean_up(self.ranks, [["method"]], "mean_rank"), "method", "full")

    def to_csv(self, path: str, mode: str = "errorifexists") -> None:
        """Skill and ranks; what is at the path stays unless mode says otherwise. The same holds for the other two."""
        self.to_dataframe().write.mode(mode).option("header", "true").csv(path)

    def to_json(self, path: str, mode: str = "errorifexists") -> None:
        self.to_dataframe().write.mode(mode).json(path)

    def to_parquet(self, path: str, mode: str = "errorifexists") -> None:
        """Errors by unit."""
        self.errors.write.mode(mode).option("compression", "zstd").parquet(path)


def _results(errors: DataFrame, tasks: list[str], baseline: str, subgroups: DataFrame | None) -> Results:
    fair = None
    if subgroups is not None:
        named = errors.join(subgroups, "user_id")
        attributes = [c for c in subgroups.columns if c != "user_id"]
        groups = L.subgroups(named, {a: F.col(a) for a in attributes}).where("attribute <> 'all'").groupBy("method", *tasks, "attribute", "subgroup").agg(F.avg("e").alias("e"))
        fair = L.fairness(groups, tasks, "attribute", "subgroup", baseline)
    return Results(errors, L.paired_skill(errors, tasks, baseline), L.mean_ranks(errors, tasks), fair)


def evaluate_imputation(cells: DataFrame, methods: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None, subgroups: DataFrame | None = None) -> Results:
    """cells: user_id, channel, hour_idx, v, masked. methods: functions of (values, mask) for one series, by name.

    The built-in methods are always there, locf being the baseline. subgroups: user_id and its attributes.
    """
    rows = I.impute(cells)
    for name, fill in (methods or {}).items():
        rows = rows.unionByName(ML.impute_with(cells, ["user_id", "channel"], "hour_idx", "v", "masked", fill, name).select(*rows.columns))
    errors = rows.groupBy("method", "channel", "user_id").agg(F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("e"))
    return _results(errors, ["channel"], "locf", subgroups)


def evaluate_forecasting(series: DataFrame, horizon: int, season: int, models: dict[str, Callable[[np.ndarray, int], np.ndarray]] | None = None, subgroups: DataFrame | None = None) -> Results:
    """series: user_id, channel, step, v, start. Errors are per user and channel; seasonal_naive is the baseline."""
    keys = ["user_id", "channel"]
    naive = I.seasonal_naive(series, keys, "step", "v", "start", horizon, season).withColumn("method", F.lit("seasonal_naive"))
    rows = naive.select(*keys, "ahead", "pred", "method")
    for name, predict in (models or {}).items():
        rows = rows.unionByName(ML.forecast_with(series, keys, "step", "v", "start", horizon, predict, name, season).select(*rows.columns))
    truth = series.where(F.col("step") >= F.col("start")).select(*keys, (F.col("step") - F.col("start")).cast("int").alias("ahead"), "v")
    errors = rows.join(truth, [*keys, "ahead"]).groupBy("method", *keys).agg(F.avg(F.abs(F.col("v") - F.col("pred"))).alias("e"))
    return _results(errors, ["channel"], "seasonal_naive", subgroups)


def evaluate_prediction(predictions: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """predictions: method, task, user_id, y_true, y_pred. One row per method and task with the metric of its kind.

    binary: average precision and area under the curve; ordinal: rank correlation; regression: correlation.
    """
    keys = ["method", "task"]
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)]), F.col("task"))
    rows = predictions.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).withColumn("_kind", kind)
    binary = rows.where("_kind = 'binary'")
    ap = M.average_precision(binary, keys, "y_true", "y_pred").withColumnsRenamed({"ap": "value"}).withColumn("metric", F.lit("average_precision"))
    auc = M.roc_auc(binary, keys, "y_true", "y_pred").select(*keys, F.col("auc").alias("value")).withColumn("metric", F.lit("roc_auc"))
    rho = M.spearman(rows.where("_kind = 'ordinal'"), keys, "y_true", "y_pred").select(*keys, F.col("rho").alias("value")).withColumn("metric", F.lit("spearman"))
    r = rows.where("_kind = 'regression'").groupBy(*keys).agg(M.pearson_guarded("y_true", "y_pred").alias("value")).withColumn("metric", F.lit("pearson"))
    return ap.unionByName(auc).unionByName(rho).unionByName(r).select(*keys, "metric", tidy(F.col("value")).alias("value"))


def iter_split(spark: SparkSession, days: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """The days of a split's users."""
    return days.join(splits.where(F.col("split") == split).select("user_id"), "user_id", "left_semi")
