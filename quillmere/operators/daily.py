"""Features of a day from its minutes (or hours), and what users' days come to; long rows in, one row per day out.

Rows hold a user, a day, the place in the day (`at`) and the channels as columns, NULL where a channel has no reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.columns import nearest_quantile, ratio


def active_minutes(rows: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """Places of the day with a positive reading, per device."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(c) > 0).alias(f"{c}_active") for c in devices])


def wake_sedentary(rows: DataFrame, keys: list[str], at: str, steps: str, nonwear: str, wake: tuple[int, int]) -> DataFrame:
    """Readings of zero while awake, less the places where nothing was worn, never below 0."""
    inside = (F.col(at) >= wake[0]) & (F.col(at) < wake[1])
    still, off = F.count_if(inside & (F.col(steps) == 0)), F.count_if(inside & F.col(nonwear))
    return rows.groupBy(*keys).agg(F.greatest(still - off, F.lit(0)).cast("long").alias("sedentary"))


def heart_over_steps(rows: DataFrame, keys: list[str], at: str, heart: str, steps: str, wake: tuple[int, int]) -> DataFrame:
    """Median heart rate while awake over one more than the steps of an active place; NULL without either."""
    inside = (F.col(at) >= wake[0]) & (F.col(at) < wake[1])
    pulse = F.median(F.when(inside & (F.col(heart) > 0), F.col(heart)))
    walked, active = F.sum(F.when(inside, F.col(steps))), F.count_if(inside & (F.col(steps) > 0))
    return rows.groupBy(*keys).agg((pulse / (ratio(walked, active.cast("double")) + 1)).alias("hros"))


def around(at: Column, centre: Column, value: Column, half: int) -> Column:
    """Median of positive values in the 2 * half + 1 places that begin `half` before the centre, or at the day's start."""
    start = F.greatest(centre - half, F.lit(0))
    return F.median(F.when((at >= start) & (at <= start + 2 * half) & (value > 0), value))


def workout_heart(rows: DataFrame, keys: list[str], at: str, heart: str, workout: str, after: tuple[int, int, int], half: int) -> DataFrame:
    """Heart rate at the first and last place of a workout, how it rises after the first and falls after the last."""
    w, busy = Window.partitionBy(*keys), F.when(F.col(workout) > 0, F.col(at))
    own = rows.withColumn("_lo", F.min(busy).over(w)).withColumn("_hi", F.max(busy).over(w)).where("_hi IS NOT NULL")
    near = lambda edge, step: around(F.col(at), F.col(edge) + step, F.col(heart), half)
    short, middle, far = after
    got = own.groupBy(*keys).agg(near("_hi", 0).alias("at_end"), *[near("_hi", s).alias(f"_e{s}") for s in after], near("_lo", 0).alias("at_start"), *[near("_lo", s).alias(f"_s{s}") for s in (middle, far)])
    down = [(F.col("at_end") - F.col(f"_e{s}")).alias(f"recovery_{s}") for s in after]
    up = [(F.col(f"_s{s}") - F.col("at_start")).alias(f"activation_{s}") for s in (middle, far)]
    return got.select(*keys, "at_end", *down, ratio(F.col("at_end") - F.col(f"_e{middle}"), F.col("at_end")).alias("recovery_ratio"), "at_start", *up, ratio(F.col(f"_s{middle}") - F.col("at_start"), F.col("at_start")).alias("activation_ratio"))


def sleep_efficiency(rows: DataFrame, keys: list[str], asleep: str, in_bed: str) -> DataFrame:
    """Whether sleep was tracked, minutes asleep and in bed (NULL if not tracked), and their ratio, at most 1."""
    has, slept, lay = F.count(asleep) > 0, F.coalesce(F.sum(asleep), F.lit(0.0)), F.coalesce(F.sum(in_bed), F.lit(0.0))
    return rows.groupBy(*keys).agg(has.cast("int").alias("has_data"), F.sum(asleep).alias("asleep"), F.sum(in_bed).alias("in_bed"), F.when(has & (lay > 0), F.least(slept / lay, F.lit(1.0))).alias("efficiency"))


def user_spread(days: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Median and interquartile range (nearest rank) of daily features over a user's days."""
    out = []
    for c in columns:
        own = F.collect_list(c)  # a value per day of one user
        out += [F.median(c).alias(f"{c}_p50"), (nearest_quantile(own, 0.75) - nearest_quantile(own, 0.25)).alias(f"{c}_iqr")]
    return days.groupBy(key).agg(*out)


def profile_over_steps(profile: DataFrame, key: str, at: str, heart: str, steps: str, day: tuple[int, int], late: int) -> DataFrame:
    """Heart rate over steps along the mean day: mean and spread, by day and by night, and the ratio of the two."""
    h = F.when(F.col(heart).isNotNull(), F.col(heart) / (F.coalesce(F.col(steps), F.lit(0.0)) + 1))
    light = (F.col(at) >= day[0]) & (F.col(at) < day[1])
    dark = (F.col(at) < day[0]) | (F.col(at) >= late)
    got = profile.withColumn("_h", h).groupBy(key).agg(F.avg("_h").alias("mean"), F.stddev_pop("_h").alias("std"), F.avg(F.when(light, F.col("_h"))).alias("day_mean"), F.avg(F.when(dark, F.col("_h"))).alias("night_mean"))
    return got.withColumn("day_night_ratio", F.when(F.col("night_mean") > 0, F.col("day_mean") / F.col("night_mean")))


def retained_days(days: DataFrame, key: str, date: str, keep: Column) -> DataFrame:
    """The sorted distinct days of each user that pass."""
    return days.where(keep).groupBy(key).agg(F.array_sort(F.collect_set(date)).alias("days"))


def day_tensors(chunks: DataFrame, hours: DataFrame, key: str, date: str, at: str, value: str, period: int = 24) -> DataFrame:
    """The days of each chunk end to end as one array, NULL where an hour has no reading. chunks: key, chunk, first_day, day_offsets."""
    by_hour = hours.groupBy(key, date).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at).cast("int"), F.col(value)))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda h: F.try_element_at("_m", h))
    days = by_hour.select(key, date, filled.alias("_day"))
    placed = chunks.select(key, "chunk", "first_day", F.posexplode("day_offsets").alias("_n", "_o")).withColumn(date, F.date_add("first_day", F.col("_o").cast("int")))
    joined = placed.join(days, [key, date]).groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("_n", "_day"))).alias("_all"))
    return joined.select(key, "chunk", F.flatten(F.transform("_all", lambda s: s["_day"])).alias("tensor"))
