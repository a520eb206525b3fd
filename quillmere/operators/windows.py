"""Operators over windows of days: filling, imputing across days, histories of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known(c: str) -> Column:
    """The value, NULL where it is NaN."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def fill_forward(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps take the last value before them, leading ones the first value there is; a series without any is 0."""
    w = Window.partitionBy(*keys)
    before = F.last(known(value), ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    first = F.min_by(known(value), F.when(known(value).isNotNull(), F.col(order))).over(w)
    return series.withColumn(value, F.coalesce(before, first, F.lit(0.0)))


def number_days(days: DataFrame, key: str, date: str, size: int) -> DataFrame:
    """Each observed day's window of `size` observed days, its place in it and the window's first day."""
    w = Window.partitionBy(key).orderBy(date)
    placed = days.select(key, date).distinct().withColumn("_i", F.row_number().over(w) - 1)
    placed = placed.withColumn("window_no", F.floor(F.col("_i") / size).cast("long")).withColumn("slot", (F.col("_i") % size).cast("int")).drop("_i")
    return placed.withColumn("first_day", F.min(date).over(Window.partitionBy(key, "window_no")))


def impute_windows(cells: DataFrame, days: DataFrame, key: str, date: str, channel: str, step: str, value: str, masked: str, size: int) -> DataFrame:
    """Masked cells filled inside windows of several days and cut back to days.

    The days of a window lie end to end, so a cell takes the last known value of its channel, from an earlier day of the
    window too; before the first it takes the window's mean, and 0 where nothing is known. Metadata is the window's first day.
    """
    w = Window.partitionBy(key, "window_no", channel)
    seen = F.when(~F.col(masked), known(value))
    before = F.last(seen, ignorenulls=True).over(w.orderBy("slot", step).rowsBetween(Window.unboundedPreceding, 0))
    joined = cells.join(number_days(days, key, date, size), [key, date])
    filled = joined.withColumn("pred", F.coalesce(before, F.avg(seen).over(w), F.lit(0.0)))
    return filled.where(F.col(masked))


def history_starts(candidates: DataFrame, day: str, most_hours: int, include_short: bool) -> DataFrame:
    """Forecast starts with the hours of history they get, at most so many; those with fewer only if include_short."""
    start = F.col(day) * 24
    rows = candidates.withColumn("start", start).withColumn("n_history", F.least(start, F.lit(most_hours))).where("start > 0")
    return rows if include_short else rows.where(F.col("n_history") == most_hours)


def stacked_ranks(errors: DataFrame, methods: list[str], by: list[str], unit: str, value: str) -> DataFrame:
    """Mean ranks of methods over units with n_units counting all units, those a method has no value for too.

    Every unit stands against every method of the list; a missing value has no rank and takes none from the others. Ties
    share their mean rank.
    """
    units = errors.select(*by, unit).distinct()
    grid = units.select("*", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    rows = grid.join(errors.where(known(value).isNotNull()).select("method", *by, unit, value), ["method", *by, unit], "left")
    w = Window.partitionBy(*by, unit).orderBy(F.col(value).asc_nulls_last())
    alike = F.count(F.lit(1)).over(Window.partitionBy(*by, unit, value))
    rank = F.when(F.col(value).isNotNull(), F.rank().over(w) + (alike - 1) / 2)
    return rows.withColumn("_r", rank).groupBy("method", *by).agg(F.avg("_r").alias("mean_rank"), F.count(F.lit(1)).alias("n_units"), F.count("_r").alias("n_ranked"))
