"""State per user with eviction, and a sink that can be run again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def user_totals(events: DataFrame, key: str, lateness: str, idle_seconds: int) -> DataFrame:
    """key, n, total for each user of a stream of ts and value, given out once the user has been silent for idle_seconds.

    A user's state is a count and a sum, and is evicted when it is given out; one that comes back starts again. Rows later
    than `lateness` are dropped by the watermark. NULL values count as rows and add nothing.
    """
    kind = events.schema[key].dataType.simpleString()
    own = events.select(key, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", lateness)

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total, _ = state.get
            state.remove()
            yield pd.DataFrame({key: [who[0]], "n": [n], "total": [total]})
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for rows in batches:
            n += len(rows)
            total += float(rows["value"].sum())
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return own.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, total double", "n long, total double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def sink_once(stream: DataFrame, path: str, checkpoint: str, key: str | None = None) -> None:
    """What there is, a folder per batch; a batch that is run again after a failure overwrites its own folder.

    key: rows whose key an earlier batch has written are left out.
    """

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if key is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                earlier = spark.read.parquet(path).where(F.col("batch") != batch).select(key).distinct()
                rows = rows.join(earlier, key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
