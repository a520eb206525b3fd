"""Queries that fit models, or bring their own; most have no SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmere import api
from quillmere.functions.columns import tidy
from quillmere.operators import features as FT
from quillmere.operators import models as ML
from quillmere.plans.base import EVENTS, USER_ERRORS, cells, events, query, table


def _described(spark, d):
    """Labelled documents by shares of kinds of characters and words in their text; three of ten are held out."""
    t = F.coalesce("text", F.lit(""))
    n, words = F.greatest(F.length(t), F.lit(1)), F.split(F.trim(t), r"\s+")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    kinds = ["[a-z]", "[A-Z]", "[0-9]", r"\s", "[.,;:]", "[!#$%&*@|]", "[^\\x00-\\x7F]", r"\n"]
    x = F.array(*[share(k) for k in kinds], F.log1p(n.cast("double")), F.size(F.array_distinct(words)) / F.size(words), n / F.size(words))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality IS NOT NULL AND toxic IS NOT NULL")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) < 7
    return docs.select("doc_id", x.alias("x"), F.col("quality").cast("int").alias("y"), F.col("quality").cast("double").alias("z"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("level"), train.alias("train"))


@query("probe_binary")
def probe_binary(spark, d):
    """Probability that a document is of quality."""
    e = _described(spark, d)
    return ML.linear_probe(e.where("train"), e.where("NOT train"), "x", "y", "binary").select("doc_id", "y", tidy(F.col("prediction"), 4).alias("p"))


@query("probe_regression")
def probe_regression(spark, d):
    e = _described(spark, d)
    return ML.linear_probe(e.where("train"), e.where("NOT train"), "x", "z", "regression", robust=True).select("doc_id", tidy(F.col("z"), 4).alias("z"), tidy(F.col("prediction"), 4).alias("p"))


@query("probe_ordinal")
def probe_ordinal(spark, d):
    """Level of a document: one for quality, one for not being toxic."""
    e = _described(spark, d)
    return ML.linear_probe(e.where("train"), e.where("NOT train"), "x", "level", "ordinal", unit=True).select("doc_id", "level", F.col("prediction").cast("int").alias("p"))


@query("probe_trees")
def probe_trees(spark, d):
    """Probability that a document is of quality, by boosted trees."""
    e = _described(spark, d)
    return ML.tree_probe(e.where("train"), e.where("NOT train"), "x", "y", "binary").select("doc_id", "y", tidy(F.col("prediction"), 4).alias("p"))


@query("profile_components")
def profile_components(spark, d):
    """Principal components of day profiles, signs fixed."""
    profiles = FT.day_profile(events(spark, d), ["user_id"], F.pmod("hour_idx", F.lit(24)), "value")
    return ML.functional_components(profiles, ["user_id"], "profile", 4).select("user_id", *[tidy(F.element_at("scores", i + 1), 4).alias(f"pc{i + 1}") for i in range(4)])


def _series(spark, d):
    s = events(spark, d).groupBy("user_id", "channel", F.floor(F.col("hour_idx") / 24).alias("step")).agg(F.sum("value").alias("v"))
    return s.withColumn("start", F.lit(24).cast("long"))


@query("smoothing_forecast")
def smoothing_forecast(spark, d):
    """Level, trend and weekly season for each user and channel, six days ahead."""
    got = ML.forecast_with(_series(spark, d), ["user_id", "channel"], "step", "v", "start", 6, lambda y, h: ML.holt_winters(y, h, 7), "smoothing")
    return got.select("user_id", "channel", "ahead", tidy(F.col("pred"), 4).alias("pred"))


@query("autoregression", f"""WITH {EVENTS}, s AS (SELECT user_id, hour_idx // 24 AS step, sum(value) AS v FROM ev GROUP BY 1, 2), a AS (SELECT *, v - lag(v) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)),
b AS (SELECT user_id, y, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM a WINDOW w AS (PARTITION BY user_id ORDER BY step)),
m AS (SELECT user_id, count(*) FILTER (x2 IS NOT NULL) AS n, avg(y) FILTER (x2 IS NOT NULL) AS ym, avg(x1) FILTER (x2 IS NOT NULL) AS m1, avg(x2) AS m2, var_pop(x1) FILTER (x2 IS NOT NULL) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(y, x1) FILTER (x2 IS NOT NULL) AS y1, covar_pop(y, x2) AS y2 FROM b GROUP BY 1),
c AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM m), r AS (SELECT *, n >= 4 AND det > 1e-9 * s11 * s22 AS ok FROM c), k AS (SELECT *, CASE WHEN ok THEN (y1 * s22 - y2 * s12) / det END AS a1, CASE WHEN ok THEN (y2 * s11 - y1 * s12) / det END AS a2 FROM r)
SELECT user_id, round(a1, 4) AS ar1, round(a2, 4) AS ar2, round(ym - a1 * m1 - a2 * m2, 4) AS intercept FROM k""")
def autoregression(spark, d):
    """Two coefficients of first differences by least squares, from sums; NULL where the series is short or does not vary."""
    s = events(spark, d).groupBy("user_id", F.floor(F.col("hour_idx") / 24).alias("step")).agg(F.sum("value").alias("v"))
    got = FT.autoregression(s, "user_id", "step", "v")
    return got.select("user_id", *[tidy(F.col(c), 4).alias(c) for c in ("ar1", "ar2", "intercept")])


def _last_value(known: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    at = np.maximum.accumulate(np.where(np.isfinite(known), np.arange(len(known)), -1))
    first = np.flatnonzero(np.isfinite(known))
    if not len(first):
        return known
    return np.where(at >= 0, known[np.maximum(at, 0)], known[first[0]])


@query("plugin_imputer", f"""WITH {USER_ERRORS} SELECT channel, user_id, round(e, 6) AS e FROM ue WHERE method = 'locf' AND (user_id, channel) IN (SELECT user_id, channel FROM cells WHERE NOT masked)""")
def plugin_imputer(spark, d):
    """A function of arrays as an imputer; this one carries the last value forward, so SQL knows its errors."""
    c = cells(spark, d)
    got = ML.impute_with(c, ["user_id", "channel"], "hour_idx", "v", "masked", _last_value, "mine")
    own = c.where("NOT masked").select("user_id", "channel").distinct()
    return got.join(own, ["user_id", "channel"], "left_semi").groupBy("channel", "user_id").agg(tidy(F.avg(F.abs(F.col("gt") - F.col("pred")))).alias("e"))


@query("evaluate_imputation")
def evaluate_imputation(spark, d):
    """The whole track with a method of one's own beside the built-in ones."""
    who = events(spark, d).select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, "f").otherwise("m").alias("sex"))
    got = api.evaluate_imputation(cells(spark, d), {"mine": _last_value}, who).summary()
    return got.select("method", tidy(F.col("skill")).alias("skill"), tidy(F.col("mean_rank")).alias("mean_rank"))


@query("evaluate_forecasting")
def evaluate_forecasting(spark, d):
    got = api.evaluate_forecasting(_series(spark, d), 6, 7, {"smoothing": lambda y, h: ML.holt_winters(y, h, 7)}).summary()
    return got.select("method", tidy(F.col("skill")).alias("skill"), tidy(F.col("mean_rank")).alias("mean_rank"))


_TASKS = """WITH p AS (SELECT 'length' AS method, 'toxic' AS task, toxic AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)),
t AS (SELECT method, task, x, sum(y) AS p, count(*) AS c FROM p GROUP BY ALL), r AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS a FROM t WINDOW w AS (PARTITION BY method, task ORDER BY x DESC)),
k AS (SELECT method, task, y, rank() OVER (PARTITION BY method, task ORDER BY x) + (count(*) OVER (PARTITION BY method, task, x) - 1) / 2.0::DOUBLE AS rk FROM p),
o AS (SELECT o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS x, o_totalprice AS y FROM orders), q AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM o)
SELECT method, task, 'average_precision' AS metric, round(sum(p * tp / a) / nullif(sum(p), 0), 6) AS value FROM r GROUP BY 1, 2
UNION ALL SELECT method, task, 'roc_auc', round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) FROM k GROUP BY 1, 2
UNION ALL SELECT 'price', 'priority', 'spearman', round(corr(rx, ry), 6) FROM q
UNION ALL SELECT 'quantity', 'price', 'pearson', round(corr(l_extendedprice, l_quantity), 6) FROM lineitem"""


@query("evaluate_prediction", _TASKS)
def evaluate_prediction(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    a = docs.select(F.lit("length").alias("method"), F.lit("toxic").alias("task"), F.col("doc_id").alias("user_id"), F.col("toxic").cast("double").alias("y_true"), F.col("n_chars").cast("double").alias("y_pred"))
    b = table(spark, d, "orders").select(F.lit("price"), F.lit("priority"), "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("double"), "o_totalprice")
    c = table(spark, d, "lineitem").select(F.lit("quantity"), F.lit("price"), "l_orderkey", "l_extendedprice", "l_quantity")
    return api.evaluate_prediction(a.union(b).union(c), {"toxic": "binary", "priority": "ordinal", "price": "regression"})
