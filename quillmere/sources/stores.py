"""Tables as others leave them: Arrow streams, folders of splits, keys in paths, caches by configuration, sidecars."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path itself, so that every store Spark can read works."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_arrow_streams(spark: SparkSession, folder: str, schema: T.StructType, split: str | None = None) -> DataFrame:
    """Arrow IPC stream files: those of <folder>/<split> if it holds any, else <folder>/data-*.arrow.

    A file is one row until it is decoded on an executor, so a file is at most 2 GB; its batches come out one by one.
    Columns that a file lacks are NULL, others than the schema's are not read.
    """
    found = None
    for pattern in ([f"{folder}/{split}/*.arrow"] if split else []) + [f"{folder}/data-*.arrow"]:
        fs, where = _files(spark, pattern)
        found = sorted(str(x.getPath()) for x in fs.globStatus(where) or [])
        if found:
            break
    if not found:
        raise FileNotFoundError(f"no Arrow stream in {folder}")
    names = schema.names

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(schema)
        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_stream(content.as_buffer()) as stream:
                    for rows in stream:
                        have = set(rows.schema.names)
                        columns = [rows.column(n).cast(wanted.field(n).type) if n in have else pa.nulls(rows.num_rows, wanted.field(n).type) for n in names]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.format("binaryFile").load(found).select("content").mapInArrow(decode, schema)


def read_splits_folder(spark: SparkSession, root: str, splits: list[str] | None = None) -> DataFrame:
    """A folder with a Parquet folder per split as one table with a column `split`; without such folders, the folder itself."""
    fs, where = _files(spark, root)
    found = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory() and not x.getPath().getName().startswith(("_", ".")))
    found = [n for n in found if splits is None or n in splits]
    if not found:
        return spark.read.parquet(root).withColumn("split", F.lit(None).cast("string"))
    frame = None
    for name in found:
        own = spark.read.parquet(f"{root}/{name}").withColumn("split", F.lit(name))
        frame = own if frame is None else frame.unionByName(own, allowMissingColumns=True)
    return frame


def read_by_path(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """Parquet files whose last folders, and file name where a key is left for it, are keys: <root>/<model>/<metric>/<user>.parquet."""
    parts = F.split(F.regexp_replace(F.col("_metadata.file_path"), r"\.parquet$", ""), "/")
    frame = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    n = len(keys)
    return frame.select("*", *[F.url_decode(F.element_at(parts, i - n)).alias(k) for i, k in enumerate(keys)])


def normalise_days(days: DataFrame, channels: int = 19, minutes: int = 1440) -> DataFrame:
    """Day rows in one form: `values` (also from `data`) as arrays of floats, a list per channel; `nonwear` by minute, 0 where there is none.

    Rows with more or fewer channels than asked for are an error when they are read, not a silent change of shape.
    """
    frame = days.withColumnRenamed("values", "data") if "values" in days.columns and "data" not in days.columns else days
    frame = frame.withColumn("data", F.col("data").cast("array<array<float>>"))
    same = F.col("data").isNull() | (F.size("data") == channels)
    message = F.concat(F.lit(f"expected {channels} channels, found "), F.size("data").cast("string"))
    frame = frame.withColumn("data", F.when(same, F.col("data")).otherwise(F.raise_error(message).cast("array<array<float>>")))
    none = F.array_repeat(F.lit(0.0).cast("float"), minutes)
    return frame.withColumn("nonwear", F.coalesce(F.col("nonwear").cast("array<float>"), none) if "nonwear" in frame.columns else none)


def config_key(config: dict) -> str:
    """A name for a configuration: equal for equal content, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_table(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame], by: list[str] | None = None) -> DataFrame:
    """The table of a configuration, made once and read from then on.

    One that was not written to its end has no success mark and is written anew. by: columns whose rows lie together and in
    order, so that a reader of one key reads few row groups.
    """
    path = f"{folder}/{config_key(config)}"
    fs, mark = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        frame = make()
        frame = frame.repartitionByRange(*by).sortWithinPartitions(*by) if by else frame
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        write_meta(spark, path, config)
    return spark.read.parquet(path)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """<path>.meta.json beside a table."""
    fs, where = _files(spark, f"{path}.meta.json")
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(meta, sort_keys=True, default=str, indent=1).encode()))
    finally:
        out.close()


def read_meta(spark: SparkSession, path: str) -> dict:
    """What stands beside a table, {} if nothing does."""
    fs, where = _files(spark, f"{path}.meta.json")
    if not fs.exists(where):
        return {}
    return json.loads(spark.read.text(f"{path}.meta.json", wholetext=True).first()[0])


def write_with_meta(frame: DataFrame, path: str, meta: dict, by: list[str] | None = None) -> None:
    """A table and its sidecar: what the caller says, and the columns with their types."""
    writer = frame.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    write_meta(frame.sparkSession, path, {**meta, "columns": {f.name: f.dataType.simpleString() for f in frame.schema}})


def fallback_counts(cells: DataFrame, keys: list[str], flag: str = "is_fallback") -> DataFrame:
    """How many predictions of each key are stand-ins, n_fallback, of n_total."""
    return cells.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("n_fallback"), F.count(F.lit(1)).alias("n_total"))


def merge_fallbacks(spark: SparkSession, paths: list[str], keys: list[str]) -> DataFrame:
    """Counts of several runs (JSON lines) as one, with the share of stand-ins; NULL where nothing was predicted."""
    schema = ", ".join(f"`{k}` string" for k in keys) + ", n_fallback long, n_total long"
    rows = spark.read.schema(schema).json(paths)
    total = rows.groupBy(*keys).agg(F.sum("n_fallback").alias("n_fallback"), F.sum("n_total").alias("n_total"))
    return total.withColumn("rate", F.try_divide("n_fallback", "n_total"))


def split_batches(days: DataFrame, users: DataFrame, split: str, order: list[str], size: int, most: int | None = None) -> Iterator[list]:
    """A split's days with their mask (which values are there), `size` rows at a time, in order.

    The driver holds a partition at a time. most: only the first rows by the order.
    """
    own = days.join(users.where(F.col("split") == split).select("user_id"), "user_id", "left_semi")
    seen = F.transform("values", lambda c: F.transform(c, lambda v: v.isNotNull() & ~F.isnan(v)))
    own = own.withColumn("mask", seen).orderBy(*order)
    batch: list = []
    for row in (own.limit(most) if most is not None else own).toLocalIterator():
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
