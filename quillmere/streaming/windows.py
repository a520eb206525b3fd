"""Event-time windows; the same functions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _named(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def _agg(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _late(events: DataFrame, lateness: str | None) -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", lateness) if lateness and events.isStreaming else stamped


def tumbling(events: DataFrame, size: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    return _named(_agg(_late(events, lateness).groupBy(F.window("ts", size), *keys)), keys)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    return _named(_agg(_late(events, lateness).groupBy(F.window("ts", size, step), *keys)), keys)


def sessions(events: DataFrame, gap: str, keys: list[str], lateness: str | None = None) -> DataFrame:
    grouped = _late(events, lateness).groupBy(F.session_window("ts", gap).alias("window"), *keys)
    return _named(_agg(grouped), keys)


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; with Trigger.AvailableNow and a checkpoint it takes up where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; files already done are not read again."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def running_stats(events: DataFrame, key: str) -> DataFrame:
    """Counts, sums and squares that a stream keeps up to date."""
    return events.groupBy(key).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
