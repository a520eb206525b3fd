"""Calendar windows, gap filling and chunks of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_index(days: DataFrame, key: str, date: str, size: int, stride: int, least: int) -> DataFrame:
    """Windows of `size` calendar days from a key's first day on, every `stride` days, inside [first, last]; those with enough days.

    A day knows the windows it is in (at most size / stride of them), so windows are one aggregation and no join.
    """
    own = days.select(key, F.col(date).alias("_d")).distinct()
    w = Window.partitionBy(key)
    ranged = own.withColumn("_lo", F.min("_d").over(w)).withColumn("_hi", F.max("_d").over(w))
    offset = F.datediff("_d", "_lo")
    low = F.greatest(F.lit(0), F.ceil((offset - (size - 1)) / stride).cast("int"))
    high = F.floor(F.least(offset, F.datediff("_hi", "_lo") - (size - 1)) / stride).cast("int")
    placed = ranged.withColumn("_a", low).withColumn("_z", high).where("_a <= _z").select(key, "_d", "_lo", F.explode(F.sequence("_a", "_z")).alias("_w"))
    start = F.expr(f"date_add(_lo, _w * {stride})")
    return placed.select(key, "_d", start.alias("window_start")).groupBy(key, "window_start").agg(F.count(F.lit(1)).alias("n_days"), F.sort_array(F.collect_list(F.datediff("_d", "window_start"))).alias("day_offsets")).where(F.col("n_days") >= least)


def gap_fill(series: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """One row for every step between a key's first and last; absent ones are NULL."""
    ends = series.groupBy(*keys).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(step))
    return grid.join(series.select(*keys, step, value), [*keys, step], "left")


def tail_window(series: DataFrame, keys: list[str], step: str, value: str, hours: int) -> DataFrame:
    """The last `hours` steps up to a key's last observed one, gap-filled and padded on the left; missing is flagged."""
    last = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(step).alias("_hi"))
    grid = last.select(*keys, "_hi", F.posexplode(F.sequence(F.col("_hi") - (hours - 1), F.col("_hi"))).alias("position", step))
    joined = grid.join(series.select(*keys, step, value), [*keys, step], "left")
    return joined.select(*keys, "position", step, F.coalesce(value, F.lit(0.0)).alias(value), F.col(value).isNull().cast("int").alias("missing"))


def observed_chunks(days: DataFrame, key: str, date: str, size: int) -> DataFrame:
    """Chunks of `size` observed days in order, gaps or not; the last may be short. day_offsets are calendar days from its first."""
    w = Window.partitionBy(key).orderBy(date)
    numbered = days.select(key, date).distinct().withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    return numbered.groupBy(key, "chunk").agg(F.min(date).alias("first_day"), F.count(F.lit(1)).alias("n_days"), F.collect_list(date).alias("_d")).select(
        key, "chunk", "first_day", "n_days", (F.lit(size) - F.col("n_days")).alias("n_padding"), F.array_sort(F.transform("_d", lambda d: F.datediff(d, F.col("first_day")))).alias("day_offsets")
    )


def forecast_days(lengths: DataFrame, key: str, hours: str, horizon: int) -> DataFrame:
    """Days on which a forecast of `horizon` hours can start: 1 to (T - H) // 24."""
    top = F.floor((F.col(hours) - horizon) / 24).cast("long")
    return lengths.withColumn("_n", top).where("_n >= 1").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("day"))


def with_retained_future(candidates: DataFrame, retained: DataFrame, key: str, days: int) -> DataFrame:
    """Candidates all of whose next days are retained. A retained day serves the candidates up to `days` - 1 before it."""
    serves = retained.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.col("day") - k)).alias("day")).groupBy(key, "day").agg(F.count(F.lit(1)).alias("_n"))
    return candidates.join(serves.where(F.col("_n") == days), [key, "day"], "left_semi")


def with_retained_past(candidates: DataFrame, retained: DataFrame, key: str, days: int, least: int) -> DataFrame:
    """Candidates with at least `least` retained days among the `days` before them."""
    serves = retained.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.col("day") + k)).alias("day")).groupBy(key, "day").agg(F.count(F.lit(1)).alias("_n"))
    return candidates.join(serves.where(F.col("_n") >= least), [key, "day"], "left_semi")


def capped(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    """At most so many rows of a key, the first by a hash order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def index_pipeline(candidates: DataFrame, steps: dict, name: str) -> dict[str, DataFrame]:
    """The candidates through filters in the order given, every result under the names of those it has passed."""
    out = {name: candidates}
    for suffix, step in steps.items():
        candidates, name = step(candidates), f"{name}_{suffix}"
        out[name] = candidates
    return out
