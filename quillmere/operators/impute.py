"""Deterministic masks, imputers and the seasonal forecaster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform_bits(*parts: Column) -> Column:
    """52 bits from the md5 of whole numbers, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[x.cast("long").cast("string") for x in parts])), 1, 13), 16, 10).cast("long")


def mask_hash(*parts: Column) -> Column:
    """0 to 999 from whole numbers, the same on every engine."""
    return F.pmod(uniform_bits(*parts), F.lit(1000))


def neighbours(keys: list[str], order: list[str], value: Column) -> tuple[Column, Column]:
    """The last value that is not null up to a row and the first from it on.

    The second looks back along the reverse order: a frame that reaches forward would be read anew for each row.
    """
    back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(ahead)


def channel_means(cells: DataFrame, channel: str, known: str) -> DataFrame:
    """Mean and spread of the known cells; a spread is 1 where it cannot be told from 0."""
    std = F.stddev_pop(known)
    return cells.groupBy(channel).agg(F.avg(known).alias("mean"), F.when(F.count(known) <= 1, 1.0).when(std <= 1e-6, 1.0).otherwise(std).alias("std"), F.count(known).alias("n"))


def locf(keys: list[str], order: str, known: str) -> Column:
    """The last known value, for a head without one the first."""
    return F.coalesce(*neighbours(keys, [order], F.col(known)))


def linear(keys: list[str], order: str, known: str) -> Column:
    """Between the neighbours by distance, flat outside them."""
    a, b = neighbours(keys, [order], F.when(F.col(known).isNotNull(), F.struct(F.col(order).alias("t"), F.col(known).alias("v"))))
    share = (F.col(order) - a["t"]) / (b["t"] - a["t"])
    return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == b["t"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share)


def impute(cells: DataFrame) -> DataFrame:
    """Predictions of four methods at the masked cells of (user_id, channel, hour_idx, v, masked).

    One window pass for the neighbours; channel and hour means are small tables that join by their keys.
    """
    rows = cells.withColumn("known", F.when(~F.col("masked"), F.col("v")))
    means = rows.groupBy("channel").agg(F.avg("known").alias("_m"))
    hours = rows.groupBy("channel", F.pmod("hour_idx", F.lit(24)).alias("_h")).agg(F.avg("known").alias("_t"))
    keys = ["user_id", "channel"]
    filled = rows.withColumn("_locf", locf(keys, "hour_idx", "known")).withColumn("_lin", linear(keys, "hour_idx", "known")).where("masked")
    joined = filled.withColumn("_h", F.pmod("hour_idx", F.lit(24))).join(means, "channel").join(hours, ["channel", "_h"], "left")
    methods = {"locf": F.coalesce("_locf", "_m"), "mean": F.col("_m"), "linear": F.coalesce("_lin", "_m"), "hourly": F.coalesce("_t", "_m")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.alias("pred")) for k, v in methods.items()]))
    return joined.select(*keys, "hour_idx", F.col("v").alias("gt"), each.alias("m")).select("m.method", *keys, "hour_idx", "gt", "m.pred")


def leave_one_out_mean(rows: DataFrame, keys: list[str], value: str, fallback: str) -> Column:
    """A group's mean without the row's own value; alone in its group, the fallback."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    own = F.coalesce(F.col(value), F.lit(0.0))
    left = n - F.col(value).isNotNull().cast("int")
    return F.when(left > 0, (F.sum(value).over(w) - own) / left).otherwise(F.col(fallback))


def runs(rows: DataFrame, keys: list[str], order: str, flag: Column, least: int) -> DataFrame:
    """Runs of consecutive steps with the flag, at least so long: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(order)
    islands = rows.where(flag).withColumn("_g", F.col(order) - F.row_number().over(w))
    return islands.groupBy(*keys, "_g").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")).where(F.col("run_length") >= least).drop("_g")


def block_mask(cells: DataFrame, keys: list[str], block: Column, valid: Column, share: float, *order: Column) -> DataFrame:
    """Whole blocks in a hash order until the share of valid cells is reached: the block that crosses it is still taken."""
    per = cells.withColumn("_b", block).groupBy(*keys, "_b").agg(F.count_if(valid).alias("_n")).where("_n > 0")
    w = Window.partitionBy(*keys).orderBy(*order, "_b").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("_n").over(w), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    return per.withColumn("_done", done).withColumn("_total", total).where(F.col("_done") < F.floor(F.col("_total") * share)).select(*keys, F.col("_b").alias("block"), F.col("_n").alias("n_masked"))


def seasonal_naive(history: DataFrame, keys: list[str], step: str, value: str, start: str, horizon: int, season: int = 24, seasons: int = 7) -> DataFrame:
    """For each hour ahead the last observed value of the same hour, up to so many seasons back; else the mean, else 0.

    history: keys, step, value and the step where the forecast starts. Rows look ahead to the steps they can stand for, so
    the lookup is one aggregation.
    """
    past = history.where((F.col(step) < F.col(start)) & F.col(value).isNotNull())
    ends = history.groupBy(*keys, start).agg(F.avg(F.when(F.col(step) < F.col(start), F.col(value))).alias("_mean"))
    ahead = F.pmod(F.col(step) - F.col(start), F.lit(season))
    # an hour ahead h repeats the same hour of the last `seasons` seasons before the start
    recent = past.where(F.col(step) >= F.col(start) - season * seasons).withColumn("_phase", ahead).groupBy(*keys, start, "_phase").agg(F.max_by(value, step).alias("_last"))
    grid = ends.select(*keys, start, "_mean", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("ahead")).withColumn("_phase", F.pmod(F.col("ahead").cast("long"), F.lit(season)))
    return grid.join(recent, [*keys, start, "_phase"], "left").select(*keys, start, "ahead", F.coalesce("_last", "_mean", F.lit(0.0)).alias("pred"))
