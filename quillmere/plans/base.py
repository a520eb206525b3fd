"""How queries are registered, and the tables that many of them start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import impute as I

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CHANNELS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
CATEGORY = {"click": "activity", "view": "activity", "purchase": "physiology", "error": "sleep", "signup": "workouts"}


def lookup(mapping: dict, column: str):
    return F.element_at(F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v)]), F.col(column))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their hour since 2024-01-01, day and channel."""
    ts = F.col("ts").cast("timestamp_ntz")
    hour = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ts) / 3600).cast("long")
    return table(spark, d, "events").select("event_id", ts.alias("ts"), "user_id", F.col("event_type").alias("channel"), "value", "props").withColumn("hour_idx", hour).withColumn("day", F.col("ts").cast("date"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums per user and channel, half of them masked by a hash of the cell."""
    own = events(spark, d).groupBy("user_id", "channel", "hour_idx").agg(F.sum("value").alias("v"))
    return own.withColumn("masked", I.mask_hash(F.col("user_id"), F.col("hour_idx"), lookup(CHANNELS, "channel")) < 500)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return I.impute(cells(spark, d))


EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type AS channel, value, props, (floor(epoch(ts) / 3600))::BIGINT - 473352 AS hour_idx, ts::DATE AS day FROM events)"""
CHANNEL_NO = "(CASE channel WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END)"
CATEGORY_SQL = "(CASE channel WHEN 'click' THEN 'activity' WHEN 'view' THEN 'activity' WHEN 'purchase' THEN 'physiology' WHEN 'error' THEN 'sleep' ELSE 'workouts' END)"


def uniform_sql(*parts: str) -> str:
    """The 52 bits of impute.uniform_bits."""
    joined = " || ':' || ".join(f"({p})::BIGINT::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 13))::BIGINT"


def mask_sql(*parts: str) -> str:
    return f"({uniform_sql(*parts)} % 1000)"


def draw_sql(seed: int, draw: str = "k", unit: str = "user_id") -> str:
    return f"{uniform_sql(str(seed), draw, unit)} / 4503599627370496.0::DOUBLE AS h"


CELLS = EVENTS + f""",
c0 AS (SELECT user_id, channel, hour_idx, sum(value) AS v FROM ev GROUP BY ALL),
cells AS (SELECT *, {mask_sql("user_id", "hour_idx", CHANNEL_NO)} < 500 AS masked FROM c0)"""
PREDICTIONS = CELLS + """,
kn AS (SELECT *, CASE WHEN NOT masked THEN v END AS known FROM cells),
cm AS (SELECT channel, avg(known) AS m FROM kn GROUP BY 1),
hm AS (SELECT channel, hour_idx % 24 AS h, avg(known) AS t FROM kn GROUP BY 1, 2),
nb AS (SELECT *,
  last_value(CASE WHEN known IS NOT NULL THEN hour_idx END IGNORE NULLS) OVER wb AS ta, last_value(known IGNORE NULLS) OVER wb AS va,
  first_value(CASE WHEN known IS NOT NULL THEN hour_idx END IGNORE NULLS) OVER wf AS tb, first_value(known IGNORE NULLS) OVER wf AS vb
  FROM kn WINDOW wb AS (PARTITION BY user_id, channel ORDER BY hour_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  wf AS (PARTITION BY user_id, channel ORDER BY hour_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
pm AS (SELECT n.user_id, n.channel, n.hour_idx, n.v AS gt, coalesce(va, vb, m) AS p_locf, m AS p_mean, coalesce(t, m) AS p_hourly,
  coalesce(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (n.hour_idx - ta)::DOUBLE / (tb - ta) END, m) AS p_linear
  FROM nb n JOIN cm USING (channel) LEFT JOIN hm ON hm.channel = n.channel AND hm.h = n.hour_idx % 24 WHERE masked),
preds AS (SELECT 'locf' AS method, user_id, channel, hour_idx, gt, p_locf AS pred FROM pm UNION ALL SELECT 'mean', user_id, channel, hour_idx, gt, p_mean FROM pm
  UNION ALL SELECT 'linear', user_id, channel, hour_idx, gt, p_linear FROM pm UNION ALL SELECT 'hourly', user_id, channel, hour_idx, gt, p_hourly FROM pm)"""
USER_ERRORS = PREDICTIONS + """,
ue AS (SELECT method, channel, user_id, avg(abs(gt - pred)) AS e FROM preds GROUP BY ALL)"""


def user_errors(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("method", "channel", "user_id").agg(F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("e"))
