"""Metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.columns import ratio


def average_rank(keys: list[str], by: Column) -> Column:
    """Rank from 1, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(by)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, by)) - 1) / 2.0


def sufficient_stats(rows: DataFrame, keys: list[str], cut: float) -> DataFrame:
    """Per key: n, squared and absolute errors, and the four cells of the confusion matrix at the cut."""
    gt, pred = F.col("gt") > cut, F.col("pred") > cut
    d = F.col("pred") - F.col("gt")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sse"), F.sum(F.abs(d)).alias("sae"),
        F.count_if(gt & pred).alias("tp"), F.count_if(~gt & ~pred).alias("tn"), F.count_if(~gt & pred).alias("fp"), F.count_if(gt & ~pred).alias("fn"),
    )


def balanced_accuracy() -> Column:
    p, n = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return F.when((p > 0) & (n > 0), (F.col("tp") / p + F.col("tn") / n) / 2)


def f1() -> Column:
    return ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))


def roc_auc(rows: DataFrame, keys: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Area under the curve per key, ties half; NULL where only one class is there.

    Rows are first summed by score, so the window runs over distinct scores and large keys combine on the map side.
    """
    w_ = F.col(weight) if weight else F.lit(1)
    ties = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, w_).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w_)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ties.withColumn("_b", below).groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2.0)).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg")).select(
        *keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc")
    )


def average_precision(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Step-wise area under precision and recall, ties as one threshold."""
    ties = rows.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    run = ties.withColumn("_tp", F.sum("_p").over(w)).withColumn("_all", F.sum("_c").over(w))
    return run.groupBy(*keys).agg((F.sum(F.col("_p") * F.col("_tp") / F.col("_all")) / F.when(F.sum("_p") > 0, F.sum("_p"))).alias("ap"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks; NULL where either is constant."""
    ranked = rows.withColumn("_x", average_rank(keys, F.col(x))).withColumn("_y", average_rank(keys, F.col(y)))
    return ranked.groupBy(*keys).agg(F.when((F.var_pop("_x") > 0) & (F.var_pop("_y") > 0), F.corr("_x", "_y")).alias("rho"), F.count(F.lit(1)).alias("n"))


def pearson_guarded(x: str, y: str, eps: float = 1e-12) -> Column:
    return F.when((F.var_pop(x) >= eps) & (F.var_pop(y) >= eps), F.corr(x, y))


def r_squared(gt: str, pred: str) -> Column:
    """1 - SSE / SST; NULL where the truth does not vary."""
    d = F.col(gt) - F.col(pred)
    sst = F.var_pop(gt) * F.count(gt)
    return F.when(F.var_pop(gt) > 1e-12, 1 - F.sum(d * d) / sst)


def seasonal_scale(grid: DataFrame, keys: list[str], step: str, value: str, season: int = 24) -> DataFrame:
    """Mean absolute difference a season apart, by phase and overall (phase -1); NULL where it is 0.

    A row stands for itself and for the one a season on, so pairs meet in one aggregation without a self-join.
    """
    own = grid.where(F.col(value).isNotNull()).select(*keys, F.explode(F.array(F.struct(F.col(step).alias("s"), F.lit(0).alias("late"), F.col(value).alias("v")), F.struct((F.col(step) + season).alias("s"), F.lit(1).alias("late"), F.col(value).alias("v")))).alias("e")).select(*keys, "e.*")
    pairs = own.groupBy(*keys, "s").agg(F.max(F.when(F.col("late") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("late") == 1, F.col("v"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    phased = pairs.select(*keys, F.abs(F.col("a") - F.col("b")).alias("d"), F.explode(F.array(F.pmod("s", F.lit(season)), F.lit(-1).cast("long"))).alias("phase"))
    return phased.groupBy(*keys, "phase").agg(F.when(F.avg("d") > 0, F.avg("d")).alias("scale"))


def pinball(y: Column, q_pred: Column, level: Column) -> Column:
    return (level - (y <= q_pred).cast("double")) * (y - q_pred)
