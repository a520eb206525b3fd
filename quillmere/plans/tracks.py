"""Queries of the imputation and forecasting tracks: masks, imputers, errors, skill, rank, fairness, resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmere.functions.columns import geomean, skill_ratio, tidy
from quillmere.operators import calendar as C
from quillmere.operators import impute as I
from quillmere.operators import leaderboard as L
from quillmere.operators import metrics as M
from quillmere.plans.base import CATEGORY, CATEGORY_SQL, CELLS, CHANNEL_NO, CHANNELS, EVENTS, PREDICTIONS, USER_ERRORS, cells, draw_sql, events, lookup, mask_sql, predictions, query, table, user_errors


@query("impute_predictions", f"WITH {PREDICTIONS} SELECT method, user_id, channel, hour_idx, round(gt, 6) AS gt, round(pred, 6) AS pred FROM preds")
def impute_predictions(spark, d):
    return predictions(spark, d).select("method", "user_id", "channel", "hour_idx", tidy(F.col("gt")).alias("gt"), tidy(F.col("pred")).alias("pred"))


@query("impute_locf", f"WITH {PREDICTIONS} SELECT user_id, channel, hour_idx, round(pred, 6) AS pred FROM preds WHERE method = 'locf'")
def impute_locf(spark, d):
    rows = cells(spark, d).withColumn("known", F.when(~F.col("masked"), F.col("v")))
    filled = rows.withColumn("_f", I.locf(["user_id", "channel"], "hour_idx", "known")).where("masked")
    means = rows.groupBy("channel").agg(F.avg("known").alias("m"))
    return filled.join(means, "channel").select("user_id", "channel", "hour_idx", tidy(F.coalesce("_f", "m")).alias("pred"))


@query("impute_linear", f"WITH {PREDICTIONS} SELECT user_id, channel, hour_idx, round(pred, 6) AS pred FROM preds WHERE method = 'linear'")
def impute_linear(spark, d):
    return predictions(spark, d).where("method = 'linear'").select("user_id", "channel", "hour_idx", tidy(F.col("pred")).alias("pred"))


@query("impute_loso_mean", f"""WITH {EVENTS}, s AS (SELECT user_id, channel, day, sum(value) AS v FROM ev GROUP BY ALL), g AS (SELECT channel, avg(v) AS m FROM s GROUP BY 1)
SELECT user_id, s.channel, day::VARCHAR AS day, round(coalesce((sum(v) OVER w - v) / nullif(count(v) OVER w - 1, 0), m), 6) AS pred FROM s JOIN g ON s.channel = g.channel WINDOW w AS (PARTITION BY user_id, s.channel)""")
def impute_loso_mean(spark, d):
    s = events(spark, d).groupBy("user_id", "channel", "day").agg(F.sum("value").alias("v"))
    rows = s.join(s.groupBy("channel").agg(F.avg("v").alias("m")), "channel")
    return rows.select("user_id", "channel", F.col("day").cast("string").alias("day"), tidy(I.leave_one_out_mean(rows, ["user_id", "channel"], "v", "m")).alias("pred"))


@query("impute_mode", f"""WITH {CELLS}, k AS (SELECT channel, round(v, 0) AS r FROM cells WHERE NOT masked), n AS (SELECT channel, r, count(*) AS c FROM k GROUP BY 1, 2),
x AS (SELECT channel, r, row_number() OVER (PARTITION BY channel ORDER BY c DESC, r) AS i FROM n) SELECT channel, r::DOUBLE AS mode_value FROM x WHERE i = 1""")
def impute_mode(spark, d):
    known = cells(spark, d).where("NOT masked").withColumn("r", F.round("v", 0))
    return known.groupBy("channel").agg(F.mode("r", True).alias("mode_value"))


@query("channel_stats", f"""WITH {CELLS} SELECT channel, round(avg(v), 6) AS mean, round(CASE WHEN count(v) <= 1 OR stddev_pop(v) <= 1e-6 THEN 1.0 ELSE stddev_pop(v) END, 6)::DOUBLE AS std, count(v) AS n FROM cells WHERE user_id % 10 < 6 GROUP BY 1""")
def channel_stats(spark, d):
    got = I.channel_means(cells(spark, d).where("user_id % 10 < 6"), "channel", "v")
    return got.select("channel", tidy(F.col("mean")).alias("mean"), tidy(F.col("std")).alias("std"), "n")


@query("fallback_fill", f"WITH {CELLS} SELECT channel, CASE WHEN channel IN ('error', 'signup') THEN (avg((v > 50)::INT) > 0.5)::INT::DOUBLE ELSE round(avg(v), 6) END AS fill FROM cells WHERE NOT masked GROUP BY 1")
def fallback_fill(spark, d):
    major = (F.avg((F.col("v") > 50).cast("int")) > 0.5).cast("double")
    return cells(spark, d).where("NOT masked").groupBy("channel").agg(F.when(F.col("channel").isin("error", "signup"), major).otherwise(tidy(F.avg("v"))).alias("fill"))


@query("zscore_cells", f"WITH {CELLS}, s AS (SELECT channel, avg(v) AS m, stddev_pop(v) AS sd FROM cells GROUP BY 1) SELECT user_id, channel, hour_idx, round((v - m) / CASE WHEN sd <= 1e-6 THEN 1 ELSE sd END, 6) AS z FROM cells JOIN s USING (channel)")
def zscore_cells(spark, d):
    rows = cells(spark, d)
    stats = I.channel_means(rows, "channel", "v")
    return rows.join(stats, "channel").select("user_id", "channel", "hour_idx", tidy((F.col("v") - F.col("mean")) / F.col("std")).alias("z"))


@query("hybrid_normalise", f"""WITH {CELLS}, g AS (SELECT channel, avg(v) AS gm, var_samp(v) AS gv FROM cells GROUP BY 1), u AS (SELECT user_id, channel, count(v) AS n, avg(v) AS um, coalesce(var_samp(v), 0) AS uv FROM cells GROUP BY 1, 2)
SELECT user_id, u.channel, round((n * um + 10 * gm) / (n + 10), 6) AS mean, round((n * uv + 10 * gv) / (n + 10), 6) AS variance FROM u JOIN g ON u.channel = g.channel""")
def hybrid_normalise(spark, d):
    rows = cells(spark, d)
    g = rows.groupBy("channel").agg(F.avg("v").alias("gm"), F.var_samp("v").alias("gv"))
    u = rows.groupBy("user_id", "channel").agg(F.count("v").alias("n"), F.avg("v").alias("um"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("uv"))
    mixed = lambda own, base: tidy((F.col("n") * F.col(own) + 10 * F.col(base)) / (F.col("n") + 10))
    return u.join(g, "channel").select("user_id", "channel", mixed("um", "gm").alias("mean"), mixed("uv", "gv").alias("variance"))


@query("hour_profile_fill", f"""WITH {CELLS}, k AS (SELECT channel, hour_idx % 24 AS hour, avg(v) AS m FROM cells WHERE NOT masked GROUP BY 1, 2), g AS (SELECT channel, avg(v) AS f FROM cells WHERE NOT masked GROUP BY 1)
SELECT g.channel, h.hour, round(coalesce(k.m, f), 6) AS fill FROM g CROSS JOIN range(0, 24) h(hour) LEFT JOIN k ON k.channel = g.channel AND k.hour = h.hour""")
def hour_profile_fill(spark, d):
    known = cells(spark, d).where("NOT masked")
    means = known.groupBy("channel").agg(F.avg("v").alias("f")).select("channel", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    own = known.groupBy("channel", F.pmod("hour_idx", F.lit(24)).alias("hour")).agg(F.avg("v").alias("m"))
    return means.join(own, ["channel", "hour"], "left").select("channel", "hour", tidy(F.coalesce("m", "f")).alias("fill"))


# -- masks


@query("mask_random_block", f"""WITH {CELLS}, b AS (SELECT user_id, channel, hour_idx // 24 AS block, count(*) AS n FROM cells GROUP BY ALL),
o AS (SELECT *, {mask_sql("user_id", "block", CHANNEL_NO)} AS h FROM b),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY h, {CHANNEL_NO}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(n) OVER (PARTITION BY user_id) AS total FROM o)
SELECT user_id, channel, block, n AS n_masked FROM r WHERE done < floor(total * 0.5)""")
def mask_random_block(spark, d):
    code = lookup(CHANNELS, "channel").cast("long")
    key = F.struct(code.alias("no"), "channel", F.floor(F.col("hour_idx") / 24).alias("block"))
    order = I.mask_hash(F.col("user_id"), F.col("_b.block"), F.col("_b.no"))
    return I.block_mask(cells(spark, d), ["user_id"], key, F.lit(True), 0.5, order).select("user_id", "block.channel", "block.block", "n_masked")


@query("mask_temporal_slice", f"""WITH {CELLS}, u AS (SELECT DISTINCT user_id FROM cells), s AS (SELECT user_id, k, (user_id * 7919 + k * 104729) % 690 AS lo, 12 + (user_id * 104729 + k * 7919) % 13 AS len FROM u, range(0, 8) r(k))
SELECT DISTINCT c.user_id, c.channel, c.hour_idx FROM cells c JOIN s ON c.user_id = s.user_id AND c.hour_idx >= lo AND c.hour_idx < lo + len""")
def mask_temporal_slice(spark, d):
    rows = cells(spark, d).select("user_id", "channel", "hour_idx")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    slices = rows.select("user_id").distinct().withColumn("k", k).withColumn("lo", F.pmod(F.col("user_id") * 7919 + F.col("k") * 104729, F.lit(690))).withColumn("len", 12 + F.pmod(F.col("user_id") * 104729 + F.col("k") * 7919, F.lit(13)))
    hours = slices.select("user_id", F.explode(F.sequence("lo", F.col("lo") + F.col("len") - 1)).alias("hour_idx")).distinct()
    return rows.join(hours, ["user_id", "hour_idx"], "left_semi").select("user_id", "channel", "hour_idx")


@query("mask_signal_slice", f"""WITH {CELLS}, x AS (SELECT DISTINCT user_id, hour_idx // 24 AS d, channel FROM cells),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY {mask_sql("user_id", "d", CHANNEL_NO)}, {CHANNEL_NO}) AS i, count(*) OVER (PARTITION BY user_id, d) AS n FROM x)
SELECT user_id, d AS day_no, channel FROM r WHERE CASE WHEN (user_id + d) % 2 = 0 THEN i <= ceil(n * 0.5) ELSE channel IN ('click', 'view') END""")
def mask_signal_slice(spark, d):
    x = cells(spark, d).select("user_id", F.floor(F.col("hour_idx") / 24).alias("day_no"), "channel").distinct()
    code = lookup(CHANNELS, "channel")
    w = Window.partitionBy("user_id", "day_no")
    i = F.row_number().over(w.orderBy(I.mask_hash(F.col("user_id"), F.col("day_no"), code), code))
    ranked = x.withColumn("i", i).withColumn("n", F.count(F.lit(1)).over(w))
    keep = F.when((F.col("user_id") + F.col("day_no")) % 2 == 0, F.col("i") <= F.ceil(F.col("n") * 0.5)).otherwise(F.col("channel").isin("click", "view"))
    return ranked.where(keep).select("user_id", "day_no", "channel")


@query("mask_semantic", f"WITH {CELLS}, h AS (SELECT DISTINCT user_id, hour_idx FROM cells WHERE channel = 'error') SELECT c.user_id, c.channel, c.hour_idx FROM cells c SEMI JOIN h ON c.user_id = h.user_id AND c.hour_idx = h.hour_idx WHERE channel NOT IN ('error', 'signup')")
def mask_semantic(spark, d):
    rows = cells(spark, d)
    hours = rows.where("channel = 'error'").select("user_id", "hour_idx").distinct()
    return rows.where("channel NOT IN ('error', 'signup')").join(hours, ["user_id", "hour_idx"], "left_semi").select("user_id", "channel", "hour_idx")


@query("mask_workout_gap", f"WITH {CELLS}, w AS (SELECT DISTINCT user_id, hour_idx FROM cells WHERE channel = 'signup' AND v > 0), m AS (SELECT c.user_id, c.channel, c.hour_idx FROM cells c JOIN w USING (user_id, hour_idx) WHERE channel = 'purchase') SELECT user_id, count(*) AS n_masked, min(hour_idx) AS first_hour FROM m GROUP BY 1")
def mask_workout_gap(spark, d):
    rows = cells(spark, d)
    hours = rows.where("channel = 'signup' AND v > 0").select("user_id", "hour_idx").distinct()
    hit = rows.where("channel = 'purchase'").join(hours, ["user_id", "hour_idx"], "left_semi")
    return hit.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_masked"), F.min("hour_idx").alias("first_hour"))


@query("runs_islands", f"""WITH {EVENTS}, a AS (SELECT user_id, hour_idx // 6 AS slot FROM ev GROUP BY 1, 2), i AS (SELECT *, slot - row_number() OVER (PARTITION BY user_id ORDER BY slot) AS g FROM a)
SELECT user_id, min(slot) AS run_start, max(slot) AS run_end, count(*) AS run_length FROM i GROUP BY user_id, g HAVING count(*) >= 3""")
def runs_islands(spark, d):
    slots = events(spark, d).select("user_id", F.floor(F.col("hour_idx") / 6).alias("slot")).distinct()
    return I.runs(slots, ["user_id"], "slot", F.lit(True), 3)


# -- errors and metrics


@query("user_sufficient_stats", f"""WITH {PREDICTIONS} SELECT method, user_id, channel, count(*) AS n, round(sum((pred - gt) * (pred - gt)), 4) AS sse, round(sum(abs(pred - gt)), 5) AS sae,
count(*) FILTER (gt > 50 AND pred > 50) AS tp, count(*) FILTER (NOT gt > 50 AND NOT pred > 50) AS tn, count(*) FILTER (NOT gt > 50 AND pred > 50) AS fp, count(*) FILTER (gt > 50 AND NOT pred > 50) AS fn FROM preds GROUP BY ALL""")
def user_sufficient_stats(spark, d):
    got = M.sufficient_stats(predictions(spark, d), ["method", "user_id", "channel"], 50)
    return got.withColumn("sse", tidy(F.col("sse"), 4)).withColumn("sae", tidy(F.col("sae"), 5))


@query("user_macro_errors", f"""WITH {PREDICTIONS}, u AS (SELECT method, channel, user_id, avg(abs(pred - gt)) AS mae, avg((pred - gt) * (pred - gt)) AS mse FROM preds GROUP BY ALL)
SELECT method, channel, round(avg(mae), 6) AS mae, round(avg(mse), 5) AS mse, round(avg(sqrt(mse)), 6) AS rmse, count(*) AS n_users FROM u GROUP BY 1, 2""")
def user_macro_errors(spark, d):
    u = M.sufficient_stats(predictions(spark, d), ["method", "channel", "user_id"], 50)
    mse = F.col("sse") / F.col("n")
    return u.groupBy("method", "channel").agg(tidy(F.avg(F.col("sae") / F.col("n"))).alias("mae"), tidy(F.avg(mse), 5).alias("mse"), tidy(F.avg(F.sqrt(mse))).alias("rmse"), F.count(F.lit(1)).alias("n_users"))


@query("balanced_accuracy", f"""WITH {PREDICTIONS}, s AS (SELECT method, user_id, count(*) FILTER (gt > 50 AND pred > 50) AS tp, count(*) FILTER (NOT gt > 50 AND NOT pred > 50) AS tn, count(*) FILTER (gt > 50) AS p, count(*) FILTER (NOT gt > 50) AS n FROM preds WHERE channel IN ('error', 'signup') GROUP BY ALL)
SELECT method, round(avg(CASE WHEN p > 0 AND n > 0 THEN (tp / p + tn / n) / 2 END), 6) AS balanced_accuracy, count(*) FILTER (p > 0 AND n > 0) AS n_users FROM s GROUP BY 1""")
def balanced_accuracy(spark, d):
    s = M.sufficient_stats(predictions(spark, d).where("channel IN ('error', 'signup')"), ["method", "user_id"], 50).withColumn("b", M.balanced_accuracy())
    return s.groupBy("method").agg(tidy(F.avg("b")).alias("balanced_accuracy"), F.count("b").alias("n_users"))


@query("f1_threshold", f"""WITH {PREDICTIONS}, s AS (SELECT method, channel, count(*) FILTER (gt > 50 AND pred > 50) AS tp, count(*) FILTER (NOT gt > 50 AND pred > 50) AS fp, count(*) FILTER (gt > 50 AND NOT pred > 50) AS fn FROM preds GROUP BY ALL)
SELECT method, channel, round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 6)::DOUBLE AS f1 FROM s""")
def f1_threshold(spark, d):
    return M.sufficient_stats(predictions(spark, d), ["method", "channel"], 50).select("method", "channel", tidy(M.f1()).alias("f1"))


_RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE"


@query("roc_auc_per_user", f"""WITH {PREDICTIONS}, b AS (SELECT method, user_id, (gt > 50)::INT AS y, round(pred, 6) AS pred FROM preds WHERE channel IN ('error', 'signup')),
r AS (SELECT *, {_RANKED.format(k="method, user_id", x="pred")} AS rk FROM b),
s AS (SELECT method, user_id, sum(y) AS p, count(*) - sum(y) AS n, sum(rk) FILTER (y = 1) AS rs FROM r GROUP BY 1, 2)
SELECT method, user_id, p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 6) AS auc FROM s""")
def roc_auc_per_user(spark, d):
    rows = predictions(spark, d).where("channel IN ('error', 'signup')").select("method", "user_id", (F.col("gt") > 50).cast("int").alias("y"), tidy(F.col("pred")).alias("score"))
    return M.roc_auc(rows, ["method", "user_id"], "y", "score").withColumn("auc", tidy(F.col("auc")))


@query("task_auc", f"""WITH b AS (SELECT source, toxic AS y, n_chars AS x FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL), r AS (SELECT *, {_RANKED.format(k="source", x="x")} AS rk FROM b),
s AS (SELECT source, sum(y) AS p, count(*) - sum(y) AS n, sum(rk) FILTER (y = 1) AS rs FROM r GROUP BY 1)
SELECT source, p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 6) AS auc FROM s""")
def task_auc(spark, d):
    rows = table(spark, d, "labels").where("toxic IS NOT NULL").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return M.roc_auc(rows, ["source"], "toxic", "n_chars").withColumn("auc", tidy(F.col("auc")))


@query("average_precision", """WITH b AS (SELECT lang, quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL), t AS (SELECT lang, x, sum(y) AS p, count(*) AS c FROM b GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS a FROM t WINDOW w AS (PARTITION BY lang ORDER BY x DESC)) SELECT lang, round(sum(p * tp / a) / nullif(sum(p), 0), 6) AS ap FROM r GROUP BY 1""")
def average_precision(spark, d):
    rows = table(spark, d, "labels").where("quality IS NOT NULL").join(table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "n_chars"), "doc_id")
    return M.average_precision(rows, ["lang"], "quality", "n_chars").withColumn("ap", tidy(F.col("ap")))


#: The weight at h of draw_sql, as leaderboard.draw_weight gives it.
_WEIGHT = f"len(list_filter({L.POISSON_ONE}::DOUBLE[], lambda c: c <= h))"


@query("weighted_auc_draws", f"""WITH b AS (SELECT doc_id, quality AS y, n_chars AS x, k AS draw, {draw_sql(0, "k", "doc_id")} FROM labels JOIN documents USING (doc_id), range(0, 20) r(k) WHERE quality IS NOT NULL),
w AS (SELECT *, {_WEIGHT} AS w FROM b),
t AS (SELECT draw, x, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS n FROM w GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT draw, round(sum(p * (b + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM c GROUP BY 1""")
def weighted_auc_draws(spark, d):
    rows = table(spark, d, "labels").where("quality IS NOT NULL").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("w", L.draw_weight(F.col("doc_id"), F.col("draw")))
    return M.roc_auc(drawn, ["draw"], "quality", "n_chars", "w").select("draw", tidy(F.col("auc")).alias("auc"))


@query("spearman", f"""WITH o AS (SELECT o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS x, o_totalprice AS y FROM orders), r AS (SELECT o_orderstatus, {_RANKED.format(k="o_orderstatus", x="x")} AS rx, {_RANKED.format(k="o_orderstatus", x="y")} AS ry FROM o)
SELECT o_orderstatus, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("x"), F.col("o_totalprice").alias("y"))
    return M.spearman(rows, ["o_orderstatus"], "x", "y").withColumn("rho", tidy(F.col("rho")))


@query("pearson_guarded", "SELECT l_returnflag, l_linestatus, round(CASE WHEN var_pop(l_quantity) >= 1e-12 AND var_pop(l_extendedprice) >= 1e-12 THEN corr(l_quantity, l_extendedprice) END, 6) AS r, count(*) AS n FROM lineitem GROUP BY 1, 2")
def pearson_guarded(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(tidy(M.pearson_guarded("l_quantity", "l_extendedprice")).alias("r"), F.count(F.lit(1)).alias("n"))


@query("r2_distribution", f"""WITH {PREDICTIONS}, u AS (SELECT method, user_id, count(*) AS n, CASE WHEN var_pop(gt) > 1e-12 THEN 1 - sum((gt - pred) * (gt - pred)) / (var_pop(gt) * count(gt)) END AS r2 FROM preds GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT method, round(quantile_cont(r2, 0.5), 5) AS median_r2, round(quantile_cont(r2, 0.25), 5) AS q25, round(quantile_cont(r2, 0.75), 5) AS q75, count(r2) AS n_users, count(*) - count(r2) AS n_constant FROM u GROUP BY 1""")
def r2_distribution(spark, d):
    u = predictions(spark, d).groupBy("method", "user_id").agg(F.count(F.lit(1)).alias("n"), M.r_squared("gt", "pred").alias("r2")).where("n >= 2")
    q = lambda p: tidy(F.percentile("r2", F.lit(p)), 5)
    return u.groupBy("method").agg(q(0.5).alias("median_r2"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.count("r2").alias("n_users"), (F.count(F.lit(1)) - F.count("r2")).alias("n_constant"))


@query("pinball", f"""WITH {PREDICTIONS}, q AS (SELECT method, channel, gt, pred * (0.5 + l) AS qp, l FROM preds, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS l)) SELECT method, channel, round(avg((l - (gt <= qp)::INT) * (gt - qp)), 6) AS loss FROM q GROUP BY 1, 2""")
def pinball(spark, d):
    rows = predictions(spark, d).withColumn("l", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))).withColumn("qp", F.col("pred") * (0.5 + F.col("l")))
    return rows.groupBy("method", "channel").agg(tidy(F.avg(M.pinball(F.col("gt"), F.col("qp"), F.col("l")))).alias("loss"))


@query("micro_vs_macro", f"""WITH {PREDICTIONS}, w AS (SELECT method, user_id, hour_idx // 168 AS wk, sum(abs(gt - pred)) AS s, count(*) AS n FROM preds GROUP BY ALL)
SELECT method, user_id, round(sum(s) / sum(n), 6) AS micro, round(avg(s / n), 6) AS macro FROM w GROUP BY 1, 2""")
def micro_vs_macro(spark, d):
    w = predictions(spark, d).groupBy("method", "user_id", F.floor(F.col("hour_idx") / 168).alias("wk")).agg(F.sum(F.abs(F.col("gt") - F.col("pred"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return w.groupBy("method", "user_id").agg(tidy(F.sum("s") / F.sum("n")).alias("micro"), tidy(F.avg(F.col("s") / F.col("n"))).alias("macro"))


@query("fallback_rate", f"""WITH {PREDICTIONS}, n AS (SELECT channel, count(*) AS asked, count(*) FILTER (va IS NULL AND vb IS NULL) AS filled FROM nb WHERE masked GROUP BY 1) SELECT channel, asked, filled, round(filled / asked, 6) AS rate, round(max(filled / asked) OVER (), 6) AS worst FROM n""")
def fallback_rate(spark, d):
    rows = cells(spark, d).withColumn("known", F.when(~F.col("masked"), F.col("v")))
    n = rows.withColumn("f", I.locf(["user_id", "channel"], "hour_idx", "known")).where("masked").groupBy("channel").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("f").isNull()).alias("filled"))
    worst = n.agg(F.max(F.col("filled") / F.col("asked")).alias("worst"))
    return n.crossJoin(worst).select("channel", "asked", "filled", tidy(F.col("filled") / F.col("asked")).alias("rate"), tidy(F.col("worst")).alias("worst"))  # worst is one row


# -- forecasting


_SERIES = EVENTS + ", s AS (SELECT user_id, hour_idx // 4 AS slot, sum(value) AS v FROM ev GROUP BY 1, 2)"


def _slots(spark, d):
    return events(spark, d).groupBy("user_id", F.floor(F.col("hour_idx") / 4).alias("slot")).agg(F.sum("value").alias("v"))


@query("forecast_candidates", f"""WITH {EVENTS}, n AS (SELECT user_id, max(hour_idx) + 1 AS t FROM ev GROUP BY 1), c AS (SELECT user_id, unnest(generate_series(1, (t - 48) // 24)) AS day FROM n WHERE t >= 72), r AS (SELECT DISTINCT user_id, hour_idx // 24 AS day FROM ev)
SELECT user_id, day FROM c WHERE (SELECT count(*) FROM r WHERE r.user_id = c.user_id AND r.day BETWEEN c.day AND c.day + 1) = 2 AND (SELECT count(*) FROM r WHERE r.user_id = c.user_id AND r.day BETWEEN c.day - 7 AND c.day - 1) >= 3""")
def forecast_candidates(spark, d):
    e = events(spark, d)
    candidates = C.forecast_days(e.groupBy("user_id").agg((F.max("hour_idx") + 1).alias("t")), "user_id", "t", 48)
    kept = e.select("user_id", F.floor(F.col("hour_idx") / 24).alias("day")).distinct()
    return C.with_retained_past(C.with_retained_future(candidates, kept, "user_id", 2), kept, "user_id", 7, 3)


@query("per_user_cap", f"""WITH {EVENTS}, x AS (SELECT DISTINCT user_id, hour_idx // 24 AS day FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {mask_sql("user_id", "day")}, day) AS i FROM x) SELECT user_id, day FROM r WHERE i <= 5""")
def per_user_cap(spark, d):
    days = events(spark, d).select("user_id", F.floor(F.col("hour_idx") / 24).alias("day")).distinct()
    return C.capped(days, "user_id", 5, I.mask_hash(F.col("user_id"), F.col("day")), "day")


_FORECAST = _SERIES + """, h AS (SELECT * FROM s WHERE slot < 150), m AS (SELECT user_id, avg(v) AS m FROM h GROUP BY 1),
l AS (SELECT user_id, (slot - 150) % 6 + CASE WHEN (slot - 150) % 6 < 0 THEN 6 ELSE 0 END AS ph, arg_max(v, slot) AS v FROM h WHERE slot >= 150 - 42 GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM s),
f AS (SELECT u.user_id, a AS ahead, coalesce(l.v, m.m, 0) AS pred FROM u CROSS JOIN range(0, 12) r(a) LEFT JOIN m ON m.user_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id AND l.ph = a % 6)"""


def _forecast(spark, d):
    s = _slots(spark, d).withColumn("start", F.lit(150).cast("long"))
    return s, I.seasonal_naive(s, ["user_id"], "slot", "v", "start", 12, season=6, seasons=7)


@query("seasonal_naive", f"WITH {_FORECAST} SELECT user_id, ahead::INTEGER AS ahead, round(pred, 6) AS pred FROM f")
def seasonal_naive(spark, d):
    return _forecast(spark, d)[1].select("user_id", "ahead", tidy(F.col("pred")).alias("pred"))


_SCALE = """p AS (SELECT a.user_id, b.slot % 6 AS ph, abs(a.v - b.v) AS df FROM s a JOIN s b ON a.user_id = b.user_id AND b.slot = a.slot + 6),
sc AS (SELECT user_id, ph AS phase, nullif(avg(df), 0) AS scale FROM p GROUP BY 1, 2 UNION ALL SELECT user_id, -1, nullif(avg(df), 0) FROM p GROUP BY 1)"""


@query("seasonal_scale", f"WITH {_SERIES}, {_SCALE} SELECT user_id, phase, round(scale, 6) AS scale FROM sc")
def seasonal_scale(spark, d):
    return M.seasonal_scale(_slots(spark, d), ["user_id"], "slot", "v", 6).withColumn("scale", tidy(F.col("scale")))


@query("mase", f"""WITH {_FORECAST}, {_SCALE}, e AS (SELECT f.user_id, f.ahead, abs(s.v - f.pred) AS ae FROM f JOIN s ON s.user_id = f.user_id AND s.slot = 150 + f.ahead)
SELECT e.user_id, round(avg(ae), 6) AS mae, round(avg(ae / b.scale), 6) AS mase, round(avg(ae / g.scale), 6) AS mase_all, count(*) AS n FROM e LEFT JOIN sc b ON b.user_id = e.user_id AND b.phase = e.ahead % 6 LEFT JOIN sc g ON g.user_id = e.user_id AND g.phase = -1 GROUP BY 1""")
def mase(spark, d):
    s, f = _forecast(spark, d)
    scale = M.seasonal_scale(s, ["user_id"], "slot", "v", 6)
    e = f.withColumn("slot", F.col("start") + F.col("ahead")).join(s.select("user_id", "slot", "v"), ["user_id", "slot"]).withColumn("ae", F.abs(F.col("v") - F.col("pred"))).withColumn("phase", F.pmod("ahead", F.lit(6)).cast("long"))
    both = e.join(scale, ["user_id", "phase"], "left").join(scale.where("phase = -1").select("user_id", F.col("scale").alias("whole")), "user_id", "left")
    return both.groupBy("user_id").agg(tidy(F.avg("ae")).alias("mae"), tidy(F.avg(F.col("ae") / F.col("scale"))).alias("mase"), tidy(F.avg(F.col("ae") / F.col("whole"))).alias("mase_all"), F.count(F.lit(1)).alias("n"))


# -- skill, rank, fairness


_RATIOS = USER_ERRORS + """, pr AS (SELECT m.method, m.channel, m.user_id, greatest(0.01, least(100, m.e / b.e))::DOUBLE AS r FROM ue m JOIN ue b ON b.method = 'locf' AND b.channel = m.channel AND b.user_id = m.user_id WHERE m.method <> 'locf' AND b.e > 0),
sk AS (SELECT method, channel, exp(avg(ln(r))) AS ratio, count(*) AS n FROM pr GROUP BY 1, 2)"""


@query("paired_skill", f"WITH {_RATIOS} SELECT method, channel, round(1 - ratio, 6) AS skill, n AS n_pairs FROM sk")
def paired_skill(spark, d):
    return L.paired_skill(user_errors(spark, d), ["channel"], "locf").select("method", "channel", tidy(F.col("skill")).alias("skill"), "n_pairs")


@query("domain_balanced_skill", f"WITH {_RATIOS}, dm AS (SELECT method, {CATEGORY_SQL} AS domain, 1 - exp(avg(ln(ratio))) AS s FROM sk GROUP BY 1, 2) SELECT method, round(avg(s), 6) AS skill, count(*) AS n_domains FROM dm GROUP BY 1")
def domain_balanced_skill(spark, d):
    per = L.paired_skill(user_errors(spark, d), ["channel"], "locf").withColumn("domain", lookup(CATEGORY, "channel"))
    return L.domain_mean_skill(per, ["domain"], ["method"]).withColumn("skill", tidy(F.col("skill")))


_SCENARIO = PREDICTIONS + """, us AS (SELECT method, channel, hour_idx % 2 AS scenario, user_id, avg(abs(gt - pred)) AS e FROM preds GROUP BY ALL)"""


def _scenario_errors(spark, d):
    return predictions(spark, d).groupBy("method", "channel", F.pmod("hour_idx", F.lit(2)).alias("scenario"), "user_id").agg(F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("e"))


@query("three_level_skill", f"""WITH {_SCENARIO}, p AS (SELECT m.method, m.channel, m.scenario, greatest(0.01, least(100, m.e / b.e))::DOUBLE AS r FROM us m JOIN us b ON b.method = 'locf' AND b.channel = m.channel AND b.scenario = m.scenario AND b.user_id = m.user_id WHERE m.method <> 'locf' AND b.e > 0),
t AS (SELECT method, channel, scenario, exp(avg(ln(r))) AS r FROM p GROUP BY ALL), k AS (SELECT method, scenario, {CATEGORY_SQL} AS bucket, exp(avg(ln(r))) AS r FROM t GROUP BY ALL), s AS (SELECT method, scenario, exp(avg(ln(r))) AS r FROM k GROUP BY ALL)
SELECT method, round(1 - exp(avg(ln(r))), 6) AS skill FROM s GROUP BY 1""")
def three_level_skill(spark, d):
    per = L.paired_skill(_scenario_errors(spark, d), ["channel", "scenario"], "locf").withColumn("bucket", lookup(CATEGORY, "channel"))
    return L.balanced_skill(per, [["method", "scenario", "bucket"], ["method", "scenario"], ["method"]]).select("method", tidy(F.col("skill")).alias("skill"))


@query("skill_scopes", f"""WITH {_RATIOS}, x AS (SELECT method, ratio, unnest(['task:' || channel, 'cat:' || {CATEGORY_SQL}, 'overall']) AS scope FROM sk) SELECT method, scope, round(1 - exp(avg(ln(ratio))), 6) AS skill, count(*) AS n_tasks FROM x GROUP BY 1, 2""")
def skill_scopes(spark, d):
    per = L.paired_skill(user_errors(spark, d), ["channel"], "locf")
    scope = F.explode(F.array(F.concat(F.lit("task:"), "channel"), F.concat(F.lit("cat:"), lookup(CATEGORY, "channel")), F.lit("overall")))
    return per.withColumn("scope", scope).groupBy("method", "scope").agg(tidy(1 - geomean(F.col("ratio"))).alias("skill"), F.count(F.lit(1)).alias("n_tasks"))


@query("avg_rank_ties", f"WITH {USER_ERRORS}, r AS (SELECT method, channel, user_id, round(e, 9) AS e FROM ue), k AS (SELECT *, {_RANKED.format(k='channel, user_id', x='e')} AS rk FROM r) SELECT method, channel, round(avg(rk), 6) AS mean_rank, count(DISTINCT user_id) AS n_units FROM k GROUP BY 1, 2")
def avg_rank_ties(spark, d):
    rows = user_errors(spark, d).withColumn("e", F.round("e", 9))
    return L.mean_ranks(rows, ["channel"]).withColumn("mean_rank", tidy(F.col("mean_rank")))


@query("three_level_rank", f"""WITH {_SCENARIO}, r AS (SELECT method, channel, scenario, {_RANKED.format(k="channel, scenario, user_id", x="round(e, 9)")} AS rk FROM us), t AS (SELECT method, channel, scenario, avg(rk) AS rk FROM r GROUP BY ALL),
k AS (SELECT method, scenario, {CATEGORY_SQL} AS bucket, avg(rk) AS rk FROM t GROUP BY ALL), s AS (SELECT method, scenario, avg(rk) AS rk FROM k GROUP BY ALL) SELECT method, round(avg(rk), 6) AS mean_rank FROM s GROUP BY 1""")
def three_level_rank(spark, d):
    per = L.mean_ranks(_scenario_errors(spark, d).withColumn("e", F.round("e", 9)), ["channel", "scenario"]).withColumn("bucket", lookup(CATEGORY, "channel"))
    return L.mean_up(per, [["method", "scenario", "bucket"], ["method", "scenario"], ["method"]], "mean_rank").withColumn("mean_rank", tidy(F.col("mean_rank")))


@query("category_balanced", f"WITH {_RATIOS}, c AS (SELECT method, {CATEGORY_SQL} AS category, exp(avg(ln(ratio))) AS r FROM sk GROUP BY 1, 2) SELECT method, round(1 - exp(avg(ln(r))), 6) AS skill, count(*) AS n_categories FROM c GROUP BY 1")
def category_balanced(spark, d):
    per = L.paired_skill(user_errors(spark, d), ["channel"], "locf").withColumn("category", lookup(CATEGORY, "channel")).groupBy("method", "category").agg(geomean(F.col("ratio")).alias("ratio"))
    return per.groupBy("method").agg(tidy(1 - geomean(F.col("ratio"))).alias("skill"), F.count(F.lit(1)).alias("n_categories"))


_GROUPS = USER_ERRORS + """, sg AS (SELECT method, channel, 'sex' AS attribute, CASE user_id % 2 WHEN 0 THEN 'f' ELSE 'm' END AS subgroup, avg(e) AS e FROM ue GROUP BY ALL
  UNION ALL SELECT method, channel, 'band', (user_id % 5)::VARCHAR, avg(e) FROM ue GROUP BY ALL)"""


def _groups(spark, d):
    attributes = {"sex": F.when(F.col("user_id") % 2 == 0, "f").otherwise("m"), "band": F.col("user_id") % 5}
    return L.subgroups(user_errors(spark, d), attributes).where("attribute <> 'all'").groupBy("method", "channel", "attribute", "subgroup").agg(F.avg("e").alias("e"))


@query("subgroup_expand", f"""WITH {USER_ERRORS}, x AS (SELECT method, 'all' AS attribute, 'all' AS subgroup, e FROM ue UNION ALL SELECT method, 'sex', CASE user_id % 2 WHEN 0 THEN 'f' ELSE 'm' END, e FROM ue UNION ALL SELECT method, 'band', (user_id % 5)::VARCHAR, e FROM ue)
SELECT method, attribute, subgroup, round(avg(e), 6) AS e, count(*) AS n FROM x GROUP BY ALL""")
def subgroup_expand(spark, d):
    attributes = {"sex": F.when(F.col("user_id") % 2 == 0, "f").otherwise("m"), "band": F.col("user_id") % 5}
    return L.subgroups(user_errors(spark, d), attributes).groupBy("method", "attribute", "subgroup").agg(tidy(F.avg("e")).alias("e"), F.count(F.lit(1)).alias("n"))


@query("mapd_disparity", f"WITH {_GROUPS} SELECT a.method, a.channel, a.attribute, round(avg(abs(a.e - b.e)), 6) AS mapd FROM sg a JOIN sg b ON a.method = b.method AND a.channel = b.channel AND a.attribute = b.attribute AND a.subgroup < b.subgroup GROUP BY ALL")
def mapd_disparity(spark, d):
    return L.mapd(_groups(spark, d), ["method", "channel", "attribute"], "e").select("method", "channel", "attribute", tidy(F.col("mapd")).alias("mapd"))


@query("mapd_fairness", f"""WITH {_GROUPS}, m AS (SELECT a.method, a.channel, a.attribute, avg(abs(a.e - b.e)) AS d FROM sg a JOIN sg b ON a.method = b.method AND a.channel = b.channel AND a.attribute = b.attribute AND a.subgroup < b.subgroup GROUP BY ALL),
r AS (SELECT m.method, m.attribute, greatest(0.01, least(100, m.d / b.d))::DOUBLE AS r FROM m JOIN m b ON b.method = 'locf' AND b.channel = m.channel AND b.attribute = m.attribute WHERE b.d > 0),
f AS (SELECT method, attribute, 1 - exp(avg(ln(r))) AS f FROM r GROUP BY 1, 2) SELECT method, round(avg(f), 6) + 0.0 AS fairness, count(*) AS n_attributes FROM f GROUP BY 1""")
def mapd_fairness(spark, d):
    return L.fairness(_groups(spark, d), ["channel"], "attribute", "subgroup", "locf").withColumn("fairness", tidy(F.col("fairness")))


@query("legacy_fairness", f"""WITH {_GROUPS}, p AS (SELECT method, channel, attribute, subgroup, -e AS s FROM sg) SELECT method, channel, attribute, round(avg(s) - 0.5 * (max(s) - min(s)), 6) AS range_score, round(avg(s) - 0.5 * stddev_pop(s), 6) AS spread_score FROM p GROUP BY ALL""")
def legacy_fairness(spark, d):
    rows, keys = _groups(spark, d).withColumn("s", -F.col("e")), ["method", "channel", "attribute"]
    a = L.penalised(rows, keys, "s", "range", 0.5).withColumnRenamed("score", "range_score")
    b = L.penalised(rows, keys, "s", "spread", 0.5).withColumnRenamed("score", "spread_score")
    return a.join(b, keys).select(*keys, tidy(F.col("range_score")).alias("range_score"), tidy(F.col("spread_score")).alias("spread_score"))


@query("subgroup_skill", f"""WITH {_GROUPS}, b AS (SELECT channel, avg(e) AS be FROM ue WHERE method = 'locf' GROUP BY 1) SELECT method, attribute, subgroup, round(1 - exp(avg(ln(greatest(0.01, least(100, e / be))::DOUBLE))), 6) AS skill FROM sg JOIN b USING (channel) WHERE method <> 'locf' GROUP BY ALL""")
def subgroup_skill(spark, d):
    base = user_errors(spark, d).where("method = 'locf'").groupBy("channel").agg(F.avg("e").alias("be"))
    rated = _groups(spark, d).where("method <> 'locf'").join(base, "channel").withColumn("r", skill_ratio(F.col("e"), F.col("be")))
    return rated.groupBy("method", "attribute", "subgroup").agg(tidy(1 - geomean(F.col("r"))).alias("skill"))


# -- resampling

_DRAWS = USER_ERRORS + f""", pu AS (SELECT method, user_id, avg(e) AS v FROM ue GROUP BY 1, 2), dr AS (SELECT method, user_id, v, k AS draw, {draw_sql(7, "k", "user_id")} FROM pu, range(0, 100) r(k)),
bt AS (SELECT method, draw, sum({_WEIGHT} * v) / nullif(sum({_WEIGHT}), 0) AS estimate FROM dr GROUP BY 1, 2)"""


@query("bootstrap_draws", f"WITH {_DRAWS} SELECT method, draw::INTEGER AS draw, round(estimate, 6) AS estimate FROM bt")
def bootstrap_draws(spark, d):
    return L.bootstrap(user_errors(spark, d), ["method"], "user_id", "e", 100, 7).withColumn("estimate", tidy(F.col("estimate")))


@query("bootstrap_ci", f"WITH {_DRAWS} SELECT method, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS se, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, count(*) AS n_draws FROM bt WHERE estimate IS NOT NULL GROUP BY 1")
def bootstrap_ci(spark, d):
    got = L.draw_summary(L.bootstrap(user_errors(spark, d), ["method"], "user_id", "e", 100, 7), ["method"])
    return got.select("method", *[tidy(F.col(c)).alias(c) for c in ("mean", "se", "low", "high")], "n_draws")


@query("jackknife", f"WITH {USER_ERRORS}, pu AS (SELECT method, user_id, avg(e) AS v FROM ue GROUP BY 1, 2) SELECT method, user_id, round((sum(v) OVER w - v) / nullif(count(*) OVER w - 1, 0), 6) AS left_out FROM pu WINDOW w AS (PARTITION BY method)")
def jackknife(spark, d):
    return L.jackknife(user_errors(spark, d), ["method"], "user_id", "e").withColumn("left_out", tidy(F.col("left_out")))


@query("bca_interval")
def bca_interval(spark, d):
    """No SQL: it needs the normal distribution's inverse."""
    errors = user_errors(spark, d)
    point = errors.groupBy("method", "user_id").agg(F.avg("e").alias("v")).groupBy("method").agg(F.avg("v").alias("estimate"))
    got = L.bca(L.bootstrap(errors, ["method"], "user_id", "e", 200, 7).where("estimate IS NOT NULL"), L.jackknife(errors, ["method"], "user_id", "e"), point, ["method"])
    return got.select("method", *[tidy(F.col(c)).alias(c) for c in ("estimate", "low", "high", "z0", "acceleration")])
