"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next.

language        documents whose language cannot be told go
near_duplicates one document of each group of near copies stays (five-word shingles, similarity 0.8)
personal_data   what is found is replaced by its kind in brackets
mixture         sources at the square root of their sizes, by Poisson replication, in a global random order
packing         sequences of 2048 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.jaccard import keep_one_of_each
from quillmere.llm.langid import keep_identified, train
from quillmere.llm.mixing import poisson_mix
from quillmere.llm.packing import pack
from quillmere.llm.pii import mask_pii
from quillmere.llm.shared import stash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are `und` or whose best language has less than half of the posterior."""
    return keep_identified(spark, docs, train(spark, docs), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of links."""
    return keep_one_of_each(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks spans in the text; n_chars follows it."""
    return mask_pii(spark, docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and shuffles documents; a document can be in the result several times or not at all."""
    return poisson_mix(spark, docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset."""
    return pack(spark, docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: A conditional random field and a learned language model are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
