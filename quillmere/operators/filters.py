"""Row filters and preprocessing of day tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wear_filter(days: DataFrame, nonwear: str, min_wear: float = 0.5, minutes: int = 1440) -> DataFrame:
    """Days with at most (1 - min_wear) of their minutes unworn."""
    return days.where(F.col(nonwear) <= (1 - min_wear) * minutes)


def variance_filter(days: DataFrame, variances: str, floors: dict[int, float]) -> DataFrame:
    """Drops days where a watched channel's variance is under its floor; NULL, NaN and absent channels say nothing."""
    v = lambda c: F.get(F.col(variances), c)
    flat = [F.coalesce((v(c) < floor) & ~F.isnan(v(c)), F.lit(False)) for c, floor in floors.items()]
    return days.where(~reduce(Column.__or__, flat, F.lit(False)))


def eligible(days: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    return days.join(allowed.select(*on), on, "left_semi")


def cutoff_table(labels: DataFrame, user: str, date: str, days: int) -> DataFrame:
    """Per user the last label date plus some days."""
    return labels.groupBy(user).agg(F.date_add(F.max(date), days).alias("cutoff"))


def before_cutoff(rows: DataFrame, cutoffs: DataFrame, user: str, date: str) -> DataFrame:
    """Rows up to their user's cutoff; users without one keep all."""
    return rows.join(cutoffs, user, "left").where(F.col("cutoff").isNull() | (F.col(date) <= F.col("cutoff"))).drop("cutoff")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """A deterministic cap: the first n rows by an order."""
    return rows.orderBy(*order).limit(n)


def filter_chain(rows: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all steps, and one row per step with the counts before and after it, from one pass."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, keep) in enumerate(steps, 1):
        passed = passed & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    totals = rows.agg(*counts)
    report = F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i - 1}").alias("n_before"), F.col(f"n{i}").alias("n_after")) for i, (name, _) in enumerate(steps, 1)]))
    return rows.where(passed), totals.select(report.alias("r")).select("r.*")


def merge_channels(cells: DataFrame, pairs: dict[str, str], keys: list[str], channel: str = "channel", value: str = "v") -> DataFrame:
    """Secondary channels averaged into their primary, cell by cell."""
    to = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])
    named = cells.withColumn(channel, F.coalesce(F.try_element_at(to, F.col(channel)), F.col(channel)))
    return named.groupBy(*keys, channel).agg(F.avg(value).alias(value))
