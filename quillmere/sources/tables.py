"""Readers and writers: explicit schemas, partition columns for what paths encode, small JSON files beside tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("values", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("total_nonwear_minutes", T.FloatType()), T.StructField("channel_variance", T.ArrayType(T.FloatType()))])
PAIRS = T.StructType([T.StructField("scenario", T.StringType()), T.StructField("split", T.StringType()), T.StructField("channel", T.IntegerType()), T.StructField("sample_idx", T.IntegerType()), T.StructField("timestep", T.ShortType()), T.StructField("gt", T.FloatType()), T.StructField("pred", T.FloatType())])
MANIFEST = T.StructType([T.StructField("sample_idx", T.LongType()), T.StructField("user_id", T.StringType()), T.StructField("date", T.DateType())])
USER_ERRORS = T.StructType([T.StructField(n, T.StringType()) for n in ("method", "scenario", "split", "channel", "channel_type", "subgroup_attr", "subgroup_value", "user_id")] + [T.StructField("e", T.FloatType())])
SERIES_JSON = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("timestamps", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.StringType()))])))


def read_many(spark: SparkSession, *paths: str, columns: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """One table from several folders. tolerant: files that are missing or damaged are left out."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if tolerant:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    frame = None
    for p in paths:
        own = reader.parquet(p)
        frame = own if frame is None else frame.unionByName(own, allowMissingColumns=True)
    return frame.select(*columns) if columns else frame


def write_partitioned(frame: DataFrame, path: str, by: list[str], mode: str = "overwrite", skip_existing: DataFrame | None = None) -> None:
    """Parquet with zstd, a folder per key. skip_existing: keys that are there already are left as they are."""
    rows = frame.join(skip_existing.select(*by).distinct(), by, "left_anti") if skip_existing is not None else frame
    rows.repartition(*by).write.mode("append" if skip_existing is not None else mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_pairs(predictions: DataFrame, path: str) -> None:
    """Finite pairs only, by scenario, split and channel."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    write_partitioned(predictions.where(ok("gt") & ok("pred")), path, ["scenario", "split", "channel"])


def sample_manifest(days: DataFrame, path: str, user: str = "user_id", date: str = "date") -> DataFrame:
    """Sample numbers in the order of users and dates, by offsets of parts and not by one global window.

    The ordered rows are written to `path` once, with their part and their place in it; numbers come from what was written,
    so a part that is computed again cannot be numbered differently. Numbers are longs.
    """
    spark = days.sparkSession
    ordered = days.select(user, date).distinct().repartitionByRange(F.col(user), F.col(date)).withColumn("_p", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_p").orderBy(user, date)) - 1
    ordered.withColumn("_i", place).write.mode("errorifexists").parquet(path)
    placed = spark.read.parquet(path)
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_off"))
    return placed.join(offsets, "_p").select((F.col("_off") + F.col("_i")).cast("long").alias("sample_idx"), user, date)


def read_label_series(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON {label: {user: {timestamps, values}}} as rows of label, user_id, ts, value."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", SERIES_JSON).alias("j"))
    users = text.select(F.explode("j").alias("label", "by_user")).select("label", F.explode("by_user").alias("user_id", "s"))
    return users.select("label", "user_id", F.explode(F.arrays_zip("s.timestamps", "s.values")).alias("p")).select("label", "user_id", F.col("p.timestamps").cast("timestamp_ntz").alias("ts"), F.col("p.values").alias("value"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """{train, validation, test} lists of users; a user in two of them is an error."""
    schema = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("train", "validation", "test")])
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    users = rows.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in schema.names]), F.array(*schema.names))).alias("split", "users")).select("split", F.explode("users").alias("user_id"))
    twice = users.groupBy("user_id").agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("a user is in more than one split")
    return users


def write_results(frame: DataFrame, path: str, kind: str = "json") -> None:
    """Result tables as JSON lines, CSV or Parquet."""
    writer = frame.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.option("header", "true").csv(p), "parquet": writer.parquet}[kind](path)


def write_masks(masks: DataFrame, path: str) -> None:
    """Hidden cells, a folder per split and scenario; what is there of other scenarios stays."""
    write_partitioned(masks, path, ["split", "scenario"])


def read_masks(spark: SparkSession, path: str, split: str | None = None, scenario: str | None = None) -> DataFrame:
    """All masks, or those of a split or scenario: only their folders are read."""
    frame = spark.read.parquet(path)
    for column, value in (("split", split), ("scenario", scenario)):
        frame = frame if value is None else frame.where(F.col(column) == value)
    return frame


def write_window_index(index: DataFrame, path: str) -> None:
    """Windows with their day offsets as an array column, by user in order; NaN becomes NULL."""
    clean = [F.nanvl(c.name, F.lit(None).cast(c.dataType)).alias(c.name) if isinstance(c.dataType, (T.DoubleType, T.FloatType)) else F.col(c.name) for c in index.schema]
    index.select(*clean).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_task_predictions(predictions: DataFrame, path: str, kind: str) -> None:
    """user_id, y_true, y_pred and y_proba, sorted by user inside the files."""
    from quillmere.operators.labels import prediction_table

    own = prediction_table(predictions, kind).select("user_id", "y_true", "y_pred", "y_proba")
    own.repartitionByRange("user_id").sortWithinPartitions("user_id").write.mode("errorifexists").parquet(path)


def read_result_csv(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    """Result tables of a folder as CSV with a header: files named eval_*m* if there are any, else *m*. columns: names and types."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pattern in ("eval_*m*.csv", "*m*.csv"):
        found = sorted(str(x.getPath()) for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(where, pattern)))
        if found:
            return spark.read.option("header", "true").schema(", ".join(f"`{k}` {v}" for k, v in columns.items())).csv(found)
    raise FileNotFoundError(f"no result table in {folder}")


def all_nullable(kind: T.DataType) -> T.DataType:
    """The type with every field and element nullable, whatever its depth."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, all_nullable(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(all_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(all_nullable(kind.keyType), all_nullable(kind.valueType), True)
    return kind
