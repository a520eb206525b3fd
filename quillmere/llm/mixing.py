"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import ready, stash

#: Bits of the hash that make the uniform number of a document; 52 bits are exact in a double.
_UNIT = float(1 << 52)


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


#: Steps that are appended to one list before it joins the others, so that long lists are not copied at every step.
_RUN = 256


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, ... to where it is 1 in a double, by log-space recurrence."""
    top = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("c"), F.array(F.array(F.exp(-rate))).alias("all"))

    def step(acc, k):
        lp = acc["lp"] + F.log(rate) - F.log(k.cast("double"))
        c = acc["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(acc["own"], F.array(c)).alias("own"))

    def run(acc, block):
        none = F.array().cast("array<double>")
        ks = F.sequence(block * _RUN + 1, F.least((block + 1) * _RUN, top))
        return F.aggregate(ks, F.struct(acc["lp"].alias("lp"), acc["c"].alias("c"), none.alias("own")), step, lambda x: F.struct(x["lp"].alias("lp"), x["c"].alias("c"), F.concat(acc["all"], F.array(x["own"])).alias("all")))

    blocks = F.sequence(F.lit(0), F.floor((top - 1) / _RUN).cast("int"))
    return F.when(rate > 0, F.flatten(F.aggregate(blocks, start, run)["all"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: its rows, its share of the mixture and the mean repetition rate that gives that share.

    weights: target share by source (scaled to sum to 1; a source not named gets none). Without it a source's share is
    proportional to its row count to the power alpha. epochs: rows of the mixture as a multiple of the rows given.
    """
    counts = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_rows"))
    if weights:
        spread = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(F.try_element_at(spread, F.coalesce(F.col("mix_source"), F.lit(""))), F.lit(0.0))
    else:
        share = F.pow(F.col("mix_rows").cast("double"), F.lit(float(alpha)))
    raw = counts.withColumn("mix_raw", share)
    total = raw.agg(F.sum("mix_raw").alias("weight"), F.sum("mix_rows").alias("rows")).first()
    scale = float(epochs) * total["rows"] / total["weight"] if total["weight"] else 0.0
    return raw.select("mix_source", (F.lit(scale) * F.col("mix_raw") / F.col("mix_rows")).alias("mix_rate")).withColumn("mix_steps", poisson_steps(F.col("mix_rate")))


def poisson_mix(spark: SparkSession, docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Each document Poisson(rate of its source) times, in a global random order.

    Every row keeps all its columns and gains copy_no (0, 1, ...), mix_rate and mix_key (the place in the shuffled order); a
    gained column whose name the input has already gets underscores after it until it differs. A null source is a source of
    its own. The count hangs on the doc_id, on text and source where that is null; so equal ids get equal counts, rows
    without id do not, and rows that are equal throughout are dealt by the part of the input they stand in. A null text is copied
    like any other, an empty table gives an empty one, a source with rate 0 vanishes. Nothing is grouped by source beyond its
    count, so a hot source is as even as the input's files; the rates are a table of one row per source, which Spark
    broadcasts only below its own threshold.
    """
    ready(spark)
    rates = stash(spark, source_rates(docs, weights, alpha, epochs), "mix-rates").select("mix_source", "mix_rate", "mix_steps")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    source, doc = F.col("row.source"), F.col("row.doc_id").cast("string")
    ident = F.coalesce(doc, F.concat(F.lit("null:"), F.md5(F.concat_ws(":", *[F.col("row.text").cast("string") for c in docs.columns if c.lower() == "text"], F.coalesce(source.cast("string"), F.lit("null"))))))
    out = (
        docs.select(own)
        .join(rates, source.eqNullSafe(F.col("mix_source")))
        .withColumn("mix_ident", ident)
        .withColumn("mix_u", unit(F.lit(seed), F.col("mix_ident")))
        .withColumn("mix_copies", F.size(F.filter("mix_steps", lambda c: c <= F.col("mix_u"))))
        .where("mix_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
        .withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.col("mix_ident"), F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long"))
        .withColumn("mix_salt", F.spark_partition_id())  # whatever the order of rows in it, so a lost task deals them the same way again
    )
    taken, gained = {c.lower() for c in docs.columns}, []
    for name in ("copy_no", "mix_rate", "mix_key"):
        as_name = name
        while as_name.lower() in taken:
            as_name += "_"
        gained.append(F.col(name).alias(as_name))
    return out.repartition("mix_key", "mix_salt").sortWithinPartitions("mix_key").select(*[F.col(f"row.`{c}`") for c in docs.columns], *gained)


MIX_SQL = """
WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(c::DOUBLE)) AS s, sum(c)::DOUBLE AS a FROM n),
r AS (SELECT source, a / s * sqrt(c::DOUBLE) / c AS rate FROM n, t),
k AS (SELECT source, rate, i, CASE WHEN i = 0 THEN 0 ELSE ln(greatest(i, 1)::DOUBLE) END AS li FROM r, range(0, 100000) x(i) WHERE i <= ceil(rate + 12 * sqrt(rate) + 24)),
p AS (SELECT source, rate, i, exp(-rate + i * ln(rate) - sum(li) OVER w) AS p FROM k WINDOW w AS (PARTITION BY source ORDER BY i)),
f AS (SELECT source, rate, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS cdf FROM p),
u AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text || ':', '') || coalesce(source, 'null')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, f.i::INTEGER AS copy_no, round(f.rate, 9) AS mix_rate,
  ('0x' || substr(md5('mix-1-order:' || coalesce(u.doc_id::VARCHAR, 'null:' || md5(coalesce(u.text || ':', '') || coalesce(u.source, 'null'))) || ':' || f.i), 1, 15))::BIGINT AS mix_key
FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source AND f.cdf <= u.u
"""


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document of `documents`, sources at the square root of their sizes."""
    out = poisson_mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("mix_rate", F.round("mix_rate", 9))
