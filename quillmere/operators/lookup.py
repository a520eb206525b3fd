"""As-of, range and interval lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.operators.impute import neighbours


def asof_nearest(queries: DataFrame, series: DataFrame, key: str, at: str, ts: str, value: str) -> DataFrame:
    """Each query with the value of the series nearest in time, either side; the earlier one on a tie.

    One shuffle by key: series and queries are laid in one order, and the last value before and the first after are
    carried along. No pairs are made, whatever the number of values of a key. Both times are timestamps without zone.
    """
    own = series.where(F.col(value).isNotNull()).groupBy(key, F.col(ts).alias("_t")).agg(F.min(value).alias("_v"))
    left = queries.withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast(own.schema["_v"].dataType)).withColumn("_q", F.lit(True))
    right = own.select(key, "_t", "_v", F.lit(False).alias("_q"))
    both = left.unionByName(right, allowMissingColumns=True)
    hit = F.when(~F.col("_q"), F.struct("_t", "_v"))
    before, after = neighbours([key], ["_t", "_q"], hit)
    gap = lambda side: F.abs(F.timestamp_diff("MICROSECOND", F.col(f"{side}._t"), F.col("_t")))
    nearer = F.when(F.col("_b").isNull() | (gap("_a") < gap("_b")), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_b", before).withColumn("_a", after).where("_q").withColumn("_n", nearer).select(*queries.columns, F.col("_n._t").alias("match_ts"), F.col("_n._v").alias("match_value"))


def range_pairs(queries: DataFrame, series: DataFrame, key: str, at: str, ts: str, days: int) -> DataFrame:
    """Each query with all rows of the series within the days either side.

    An equi-join on key and a bucket of the window's width; a query looks into its own bucket and both neighbours.
    """
    width = 86400 * max(1, days)
    epoch = lambda c: F.timestamp_diff("SECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    probe = queries.withColumn("_b", F.floor(epoch(at) / width)).withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    build = series.withColumn("_b", F.floor(epoch(ts) / width))
    span = F.expr(f"INTERVAL {days} DAYS")
    return probe.join(build, [key, "_b"]).where((F.col(ts) >= F.col(at) - span) & (F.col(ts) <= F.col(at) + span)).drop("_b")


def intervals_from_events(events: DataFrame, key: str, ts: str, name: str, gap: str = "INTERVAL 1 SECOND") -> DataFrame:
    """Each event of a key as an interval that holds both its ends: to `gap` before the next event, the last one open.

    An event with less than that to its successor has no interval.
    """
    w = Window.partitionBy(key).orderBy(ts, name)
    own = events.select(key, F.col(name).alias("name"), F.col(ts).alias("start"), (F.lead(ts).over(w) - F.expr(gap)).alias("end"))
    return own.where("end IS NULL OR end >= start")


def interval_lookup(queries: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """Each query with the name of the interval it falls in, both ends included; intervals of a key do not overlap or touch,
    an open end is NULL.

    The same single pass as asof_nearest: the last interval that starts at or before the query, if it has not ended.
    """
    left = queries.withColumn("_t", F.col(at)).withColumn("_i", F.lit(1))
    right = intervals.select(key, F.col("start").alias("_t"), F.struct("start", "end", "name").alias("_s"), F.lit(0).alias("_i"))
    w = Window.partitionBy(key).orderBy("_t", "_i").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_i = 1")
    inside = F.col("_s.end").isNull() | (F.col("_t") <= F.col("_s.end"))
    return found.select(*queries.columns, F.when(inside, F.col("_s.name")).alias("interval_name"), F.when(inside, F.col("_s.start")).alias("interval_start"))


def interval_overlaps(intervals: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that begin no later than one before them ends; a valid timeline has none."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("prior_end", F.max(end).over(w)).where(F.col(start) <= F.col("prior_end"))


def merge_by_precedence(first: DataFrame, second: DataFrame, on: list[str], value: str) -> DataFrame:
    """All keys of both; the first table's value wins."""
    return first.withColumnRenamed(value, "_a").join(second.withColumnRenamed(value, "_b"), on, "full").select(*on, F.coalesce("_a", "_b").alias(value))
