"""Skill, rank and fairness over per-user errors, and their resampling."""

from __future__ import annotations

import itertools
import math
import itertools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.columns import geomean, skill_ratio
from quillmere.operators.impute import uniform_bits
from quillmere.operators.impute import uniform_bits
from quillmere.operators.metrics import average_rank


def paired_skill(errors: DataFrame, tasks: list[str], baseline: str, unit: str = "user_id", method: str = "method", error: str = "e", least: int = 1) -> DataFrame:
    """1 - geometric mean of error ratios over the units that both a method and the baseline have, per task.

    The baseline's error reaches the others over a window of the pairing keys, one shuffle and no self-join.
    """
    w = Window.partitionBy(*tasks, unit)
    paired = errors.withColumn("_b", F.max(F.when(F.col(method) == baseline, F.col(error))).over(w)).where(F.col(method) != baseline)
    rated = paired.withColumn("_r", skill_ratio(F.col(error), F.col("_b"))).where("_r IS NOT NULL")
    return rated.groupBy(*tasks, method).agg(geomean(F.col("_r")).alias("ratio"), F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") >= least).withColumn("skill", 1 - F.col("ratio"))


def balanced_skill(ratios: DataFrame, levels: list[list[str]], ratio: str = "ratio") -> DataFrame:
    """Geometric means up the levels: each list is what a level still keeps. The last one's skill is 1 less its mean."""
    out = ratios
    for keep in levels:
        out = out.groupBy(*keep).agg(geomean(F.col(ratio)).alias(ratio))
    return out.withColumn("skill", 1 - F.col(ratio))


def domain_mean_skill(ratios: DataFrame, domain: list[str], keep: list[str], ratio: str = "ratio") -> DataFrame:
    """Skill within each domain, then the arithmetic mean over domains."""
    return ratios.groupBy(*keep, *domain).agg((1 - geomean(F.col(ratio))).alias("_s")).groupBy(*keep).agg(F.avg("_s").alias("skill"), F.count(F.lit(1)).alias("n_domains"))


def mean_ranks(errors: DataFrame, tasks: list[str], unit: str = "user_id", method: str = "method", error: str = "e") -> DataFrame:
    """Ranks across methods for each unit, then their mean per task."""
    ranked = errors.where(F.col(error).isNotNull() & ~F.isnan(error)).withColumn("_r", average_rank([*tasks, unit], F.col(error)))
    return ranked.groupBy(*tasks, method).agg(F.avg("_r").alias("mean_rank"), F.countDistinct(unit).alias("n_units"))


def mean_up(values: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    out = values
    for keep in levels:
        out = out.groupBy(*keep).agg(F.avg(value).alias(value))
    return out


def mapd(groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean absolute difference over all pairs of subgroups, by the closed form over sorted values: no pairs are made."""
    w = Window.partitionBy(*keys)
    ranked = groups.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    term = (2 * F.col("_i") - F.col("_n") - 1) * F.col(value)
    return ranked.where("_n >= 2").groupBy(*keys).agg((2 * F.sum(term) / (F.max("_n") * (F.max("_n") - 1))).alias("mapd"), F.max("_n").alias("n_groups"))


def fairness(groups: DataFrame, tasks: list[str], attribute: str, subgroup: str, baseline: str, method: str = "method", value: str = "e") -> DataFrame:
    """Disparity of each method over the baseline's on the subgroups both have: geometric mean over tasks, mean over attributes."""
    keys = [*tasks, attribute, subgroup]
    shared = groups.withColumn("_b", F.max(F.when(F.col(method) == baseline, F.col(value))).over(Window.partitionBy(*keys))).where("_b IS NOT NULL")
    own = mapd(shared, [*tasks, attribute, method], value).withColumnRenamed("mapd", "d")
    base = mapd(shared, [*tasks, attribute, method], "_b").select(*tasks, attribute, method, F.col("mapd").alias("db"))
    rated = own.join(base, [*tasks, attribute, method]).withColumn("_r", skill_ratio(F.col("d"), F.col("db"))).where("_r IS NOT NULL")
    per = rated.groupBy(attribute, method).agg((1 - geomean(F.col("_r"))).alias("_f"))
    return per.groupBy(method).agg(F.avg("_f").alias("fairness"), F.count(F.lit(1)).alias("n_attributes"))


DISPARITIES = {
    "range": lambda x: F.max(x) - F.min(x),
    "worst": lambda x: F.max(x),
    "spread": lambda x: F.stddev_pop(x),
    "relative_drop": lambda x: F.try_divide(F.max(x) - F.min(x), F.min(x)),
}


def penalised(groups: DataFrame, keys: list[str], value: str, kind: str, weight: float) -> DataFrame:
    """Mean skill less a weighted disparity between subgroups."""
    return groups.groupBy(*keys).agg((F.avg(value) - weight * DISPARITIES[kind](value)).alias("score"))


#: The distribution function of Poisson(1) at 0, 1, ... below 1 in a double.
POISSON_ONE = [c for c in itertools.accumulate(math.exp(-1.0) / math.factorial(k) for k in range(19)) if c < 1.0]


def draw_weight(unit: Column, draw: Column, seed: int = 0) -> Column:
    """How often a unit is in a draw: the inverse of Poisson(1) at the md5 of seed, draw and unit, the same on every engine.

    Independent draws of each unit need no list of units, so the resampling runs where the rows are. The distribution is
    listed to where it is 1 in a double, so no count is cut off.
    """
    h = uniform_bits(F.lit(seed), draw, unit) / F.lit(float(1 << 52))
    return F.size(F.filter(F.array(*[F.lit(c) for c in POISSON_ONE]), lambda c: c <= h))


def bootstrap(errors: DataFrame, keys: list[str], unit: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Weighted means of `value` for each draw; units are first reduced to a row, so draws multiply the small side only."""
    per = errors.groupBy(*keys, unit).agg(F.avg(value).alias("_v")).where("_v IS NOT NULL")
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", draw_weight(F.col(unit), F.col("draw"), seed))
    return drawn.groupBy(*keys, "draw").agg((F.sum(F.col("_w") * F.col("_v")) / F.when(F.sum("_w") > 0, F.sum("_w"))).alias("estimate"))


def draw_summary(draws: DataFrame, keys: list[str], value: str = "estimate", level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return draws.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"), F.count(F.lit(1)).alias("n_draws"))


def jackknife(errors: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Means without one unit each, from the total less its own part; their acceleration for the interval below."""
    per = errors.groupBy(*keys, unit).agg(F.avg(value).alias("_v")).where("_v IS NOT NULL")
    w = Window.partitionBy(*keys)
    return per.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("left_out", (F.sum("_v").over(w) - F.col("_v")) / F.when(F.col("_n") > 1, F.col("_n") - 1)).select(*keys, unit, "left_out")


def bca(draws: DataFrame, left_out: DataFrame, point: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """Bias-corrected accelerated intervals. draws: estimate; left_out: left_out; point: estimate per key.

    Counts and moments are aggregations; only the two normal quantiles of a key are a small grouped function.
    """
    centre = point.select(*keys, F.col("estimate").alias("_p"))
    below = draws.join(centre, keys).groupBy(*keys).agg(F.avg((F.col("estimate") < F.col("_p")).cast("double")).alias("_share"), F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("estimate")).alias("_d"))
    mean = left_out.withColumn("_m", F.avg("left_out").over(Window.partitionBy(*keys)))
    moments = mean.groupBy(*keys).agg(F.sum(F.pow(F.col("_m") - F.col("left_out"), 3)).alias("_c3"), F.sum(F.pow(F.col("_m") - F.col("left_out"), 2)).alias("_c2"))
    both = below.join(moments, keys).join(centre, keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name in keys) + ", estimate double, low double, high double, z0 double, acceleration double"

    return both.withColumnsRenamed({"_share": "b_share", "_n": "b_n", "_d": "b_d", "_c3": "b_c3", "_c2": "b_c2", "_p": "b_p"}).mapInPandas(lambda it: (_intervals(p, keys, NormalDist(), level) for p in it), schema)


def _intervals(pdf, keys, normal, level):
    import numpy as np
    import pandas as pd

    rows = []
    for r in pdf.to_dict("records"):
        n, d = int(r["b_n"]), np.asarray(r["b_d"], dtype=float)
        z0 = normal.inv_cdf(min(max(r["b_share"], 0.5 / n), 1 - 0.5 / n))
        a = r["b_c3"] / (6 * r["b_c2"] ** 1.5) if r["b_c2"] and r["b_c2"] > 0 else 0.0
        edge = []
        for q in ((1 - level) / 2, (1 + level) / 2):
            z = z0 + normal.inv_cdf(q)
            edge.append(float(np.quantile(d, normal.cdf(z0 + z / (1 - a * z)) if 1 - a * z > 0 else q)))
        rows.append({**{k: r[k] for k in keys}, "estimate": r["b_p"], "low": edge[0], "high": edge[1], "z0": z0, "acceleration": a})
    return pd.DataFrame(rows, columns=[*keys, "estimate", "low", "high", "z0", "acceleration"])


def subgroups(rows: DataFrame, attributes: dict[str, Column]) -> DataFrame:
    """Each row under `all` and under its value of each attribute: one explode, one aggregation after it."""
    each = [F.struct(F.lit("all").alias("attribute"), F.lit("all").alias("subgroup"))]
    each += [F.struct(F.lit(k).alias("attribute"), F.coalesce(v.cast("string"), F.lit("unknown")).alias("subgroup")) for k, v in attributes.items()]
    return rows.withColumn("_s", F.explode(F.array(*each))).select("*", "_s.attribute", "_s.subgroup").drop("_s")
