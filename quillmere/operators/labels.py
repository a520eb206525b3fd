"""Label series with validity, manifests, covariates and personal fill values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_validity(series: DataFrame, masks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The series with `valid`: its place's entry in the mask of its keys; NULL without a mask or if their lengths differ."""
    w = Window.partitionBy(*keys)
    placed = series.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    joined = placed.join(masks.select(*keys, F.col("mask").alias("_mask")), keys, "left")
    return joined.withColumn("valid", F.when(F.size("_mask") == F.col("_n"), F.try_element_at("_mask", F.col("_i").cast("int")))).drop("_i", "_n", "_mask")


def only_valid(series: DataFrame) -> DataFrame:
    """Rows not marked invalid; a series without a mask stays whole."""
    return series.where("valid IS NULL OR valid")


def with_manifest(pairs: DataFrame, manifest: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """The pairs whose sample is in the manifest. strict: a pair without one is an error."""
    if strict and pairs.join(manifest, on, "left_anti").limit(1).count():
        raise ValueError("pairs hold samples that the manifest does not have")
    return pairs.join(manifest, on)


def covariates(frame: DataFrame, target: str, aliases: dict[str, list[str]]) -> DataFrame:
    """All columns but the target's and those that tell it under another name."""
    out = {target, *aliases.get(target, [])}
    return frame.select(*[c for c in frame.columns if c not in out])


def without_prefixes(frame: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return frame.select(*[c for c in frame.columns if not c.startswith(prefixes)])


def normalise_sex(x: Column, numbers: bool = True) -> Column:
    """male, female or unknown from words, letters, truth values and, if allowed, 1 and 0."""
    word = F.lower(F.trim(x.cast("string")))
    male, female = ["male", "m", "man", "true"], ["female", "f", "woman", "false"]
    if numbers:
        male, female = [*male, "1", "1.0"], [*female, "0", "0.0"]
    return F.when(word.isin(male), "male").when(word.isin(female), "female").otherwise("unknown")


def leave_one_out_mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with the most frequent value of its key's other rows, the smallest on a tie; NULL if it is alone.

    Only a key's two best values can matter, so rows join one row per key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_c"), F.col(value)))
    best = counts.withColumn("_r", place).where("_r <= 2").groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == r, F.col(c))).alias(f"_{c.strip('_')}{r}") for r in (1, 2) for c in (value, "_c")])
    v1, v2, c1, c2 = F.col(f"_{value}1"), F.col(f"_{value}2"), F.col("_c1") - 1, F.col("_c2")
    stays = (c1 > F.coalesce(c2, F.lit(0))) | ((c1 == c2) & (v1 < v2))
    mode = F.when(~F.col(value).eqNullSafe(v1), v1).when(stays, v1).otherwise(v2)
    return rows.join(best, keys, "left").withColumn("mode", mode).drop(f"_{value}1", f"_{value}2", "_c1", "_c2")


def seasonal_fallback(forecast: DataFrame, fallback: DataFrame, on: list[str]) -> DataFrame:
    """The forecast, with the fallback's value and a flag where it has none that is finite."""
    bad = F.col("pred").isNull() | F.isnan("pred") | (F.abs("pred") == float("inf"))
    joined = fallback.withColumnRenamed("pred", "_other").join(forecast, on, "left")
    return joined.select(*on, F.when(bad, F.col("_other")).otherwise(F.col("pred")).alias("pred"), bad.alias("is_fallback"))


def prediction_table(rows: DataFrame, kind: str) -> DataFrame:
    """y_pred and y_proba of a prediction: a class at 0.5, a level by rounding half to even, or the value itself."""
    p = F.col("prediction")
    hard = F.when(p >= 0.5, 1.0).otherwise(0.0) if kind == "binary" else F.bround(p, 0) if kind in ("ordinal", "multiclass") else p
    return rows.withColumn("y_pred", hard.cast("double")).withColumn("y_proba", p if kind == "binary" else F.lit(None).cast("double"))
