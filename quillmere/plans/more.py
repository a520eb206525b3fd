"""Further queries: structural masks, forecast windows, timing features, set checks, per-draw statistics, reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmere.functions.columns import geomean, nearest_quantile, ratio, skill_ratio, tidy, whole_years
from quillmere.operators import impute as I
from quillmere.operators import leaderboard as L
from quillmere.operators import metrics as M
from quillmere.plans.base import CELLS, CHANNEL_NO, CHANNELS, EVENTS, PREDICTIONS, USER_ERRORS, cells, draw_sql, events, lookup, mask_sql, predictions, query, table, user_errors
from quillmere.plans.tracks import _FORECAST, _RANKED, _SERIES, _WEIGHT, _forecast, _slots


@query("mask_intensity_failure", f"""WITH {EVENTS}, h AS (SELECT user_id, hour_idx // 12 AS slot, max(value) AS top FROM ev WHERE channel = 'click' GROUP BY 1, 2), i AS (SELECT *, slot - row_number() OVER (PARTITION BY user_id ORDER BY slot) AS g FROM h WHERE top > 40),
r AS (SELECT user_id, min(slot) AS a, max(slot) AS z FROM i GROUP BY user_id, g HAVING count(*) >= 2) SELECT DISTINCT e.user_id, e.channel, e.hour_idx FROM ev e JOIN r ON r.user_id = e.user_id AND e.hour_idx // 12 BETWEEN a AND z WHERE e.channel = 'purchase'""")
def mask_intensity_failure(spark, d):
    e = events(spark, d).withColumn("slot", F.floor(F.col("hour_idx") / 12))
    hot = e.where("channel = 'click'").groupBy("user_id", "slot").agg(F.max("value").alias("top"))
    runs = I.runs(hot, ["user_id"], "slot", F.col("top") > 40, 2)
    slots = runs.select("user_id", F.explode(F.sequence("run_start", "run_end")).alias("slot"))
    return e.where("channel = 'purchase'").join(slots, ["user_id", "slot"], "left_semi").select("user_id", "channel", "hour_idx").distinct()


@query("mask_applicability", f"""WITH {EVENTS}, a AS (SELECT DISTINCT user_id, CASE channel WHEN 'error' THEN 'sleep_gap' WHEN 'signup' THEN 'workout_gap' END AS scenario FROM ev WHERE channel IN ('error', 'signup') AND value > 100)
SELECT scenario, count(*) AS n_users FROM a GROUP BY 1 UNION ALL SELECT 'any', count(DISTINCT user_id) FROM a""")
def mask_applicability(spark, d):
    scenario = F.when(F.col("channel") == "error", "sleep_gap").otherwise("workout_gap")
    a = events(spark, d).where("channel IN ('error', 'signup') AND value > 100").select("user_id", scenario.alias("scenario")).distinct()
    return a.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_users")).union(a.agg(F.lit("any"), F.countDistinct("user_id")))


@query("forecast_window_slice", f"""WITH {_SERIES}, w AS (SELECT user_id, c AS cut FROM (SELECT DISTINCT user_id FROM s), (SELECT unnest([48, 96, 144])::BIGINT AS c)) SELECT w.user_id, w.cut, count(*) FILTER (slot < cut) AS n_history, count(*) FILTER (slot >= cut AND slot < cut + 12) AS n_truth, round(sum(v) FILTER (slot >= cut AND slot < cut + 12), 4) AS truth FROM w JOIN s ON s.user_id = w.user_id GROUP BY 1, 2""")
def forecast_window_slice(spark, d):
    cut = F.explode(F.array(*[F.lit(c).cast("long") for c in (48, 96, 144)]))
    rows = _slots(spark, d).withColumn("cut", cut)
    ahead = (F.col("slot") >= F.col("cut")) & (F.col("slot") < F.col("cut") + 12)
    return rows.groupBy("user_id", "cut").agg(F.count_if(F.col("slot") < F.col("cut")).alias("n_history"), F.count_if(ahead).alias("n_truth"), tidy(F.sum(F.when(ahead, F.col("v"))), 4).alias("truth"))


@query("horizon_errors", f"WITH {_FORECAST} SELECT ahead::INTEGER AS ahead, round(avg(abs(s.v - f.pred)), 6) AS mae, round(avg((s.v - f.pred) ** 2), 4) AS mse, count(*) AS n FROM f JOIN s ON s.user_id = f.user_id AND s.slot = 150 + f.ahead GROUP BY 1")
def horizon_errors(spark, d):
    s, f = _forecast(spark, d)
    e = f.withColumn("slot", F.col("start") + F.col("ahead")).join(s.select("user_id", "slot", "v"), ["user_id", "slot"]).withColumn("d", F.col("v") - F.col("pred"))
    return e.groupBy("ahead").agg(tidy(F.avg(F.abs("d"))).alias("mae"), tidy(F.avg(F.col("d") * F.col("d")), 4).alias("mse"), F.count(F.lit(1)).alias("n"))


@query("seasonal_quantiles", f"WITH {_SERIES}, p AS (SELECT user_id, slot % 6 AS phase, v FROM s WHERE slot < 150 AND slot >= 108) SELECT user_id, phase, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90, count(*) AS n FROM p GROUP BY 1, 2")
def seasonal_quantiles(spark, d):
    p = _slots(spark, d).where("slot < 150 AND slot >= 108").withColumn("phase", F.pmod("slot", F.lit(6)))
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return p.groupBy("user_id", "phase").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select("user_id", "phase", *[tidy(F.col("q")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90"))], "n")


@query("quantile_coverage", f"WITH {_SERIES}, p AS (SELECT user_id, slot % 6 AS phase, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM s WHERE slot < 150 AND slot >= 108 GROUP BY 1, 2) SELECT phase, round(avg((s.v BETWEEN lo AND hi)::INT), 6) AS coverage, count(*) AS n FROM s JOIN p ON p.user_id = s.user_id AND p.phase = s.slot % 6 WHERE s.slot >= 150 GROUP BY 1")
def quantile_coverage(spark, d):
    s = _slots(spark, d).withColumn("phase", F.pmod("slot", F.lit(6)))
    p = s.where("slot < 150 AND slot >= 108").groupBy("user_id", "phase").agg(F.percentile("v", F.lit(0.1)).alias("lo"), F.percentile("v", F.lit(0.9)).alias("hi"))
    return s.where("slot >= 150").join(p, ["user_id", "phase"]).groupBy("phase").agg(tidy(F.avg(F.col("v").between(F.col("lo"), F.col("hi")).cast("int"))).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("manifest_agreement", "WITH a AS (SELECT l_orderkey AS k, max(l_partkey) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_partkey) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_missing, count(*) FILTER (a.v <> b.v) AS n_differ FROM a FULL JOIN b ON a.k = b.k")
def manifest_agreement(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber")
    a = li.where("l_linenumber <= 3").groupBy("k").agg(F.max("l_partkey").alias("a"))
    b = li.where("l_linenumber >= 2").groupBy("k").agg(F.max("l_partkey").alias("b"))
    return a.join(b, "k", "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a") != F.col("b")).alias("n_differ"))


@query("first_valid_value", f"WITH {EVENTS}, x AS (SELECT user_id, ts, event_id, CASE WHEN value < 20 THEN -1 ELSE value END AS v FROM ev) SELECT user_id, coalesce(arg_min(v, struct_pack(t := ts, i := event_id)) FILTER (v <> -1), 0.0) AS first_value FROM x GROUP BY 1")
def first_valid_value(spark, d):
    ok = F.col("value") >= 20
    order = F.when(ok, F.struct("ts", "event_id"))
    return events(spark, d).groupBy("user_id").agg(F.coalesce(F.min_by("value", order), F.lit(0.0)).alias("first_value"))


@query("daily_timing", f"""WITH {EVENTS}, t AS (SELECT user_id, day, min(hour_idx % 24) AS first_hour, max(hour_idx % 24) AS last_hour FROM ev GROUP BY 1, 2)
SELECT user_id, round(median(first_hour), 4)::DOUBLE AS wake, round(median(last_hour), 4)::DOUBLE AS bed, round(avg((first_hour + last_hour) / 2.0::DOUBLE), 6) AS midpoint, round(coalesce(stddev_pop(first_hour), 0), 6) AS wake_spread FROM t GROUP BY 1""")
def daily_timing(spark, d):
    hour = F.pmod("hour_idx", F.lit(24))
    t = events(spark, d).groupBy("user_id", "day").agg(F.min(hour).alias("a"), F.max(hour).alias("z"))
    return t.groupBy("user_id").agg(tidy(F.median("a"), 4).alias("wake"), tidy(F.median("z"), 4).alias("bed"), tidy(F.avg((F.col("a") + F.col("z")) / 2.0)).alias("midpoint"), tidy(F.stddev_pop("a")).alias("wake_spread"))


@query("time_window_sums", f"WITH {EVENTS} SELECT user_id, round(coalesce(sum(value) FILTER (hour_idx % 24 < 5), 0), 4) AS night, round(coalesce(sum(value) FILTER (hour_idx % 24 BETWEEN 6 AND 11), 0), 4) AS morning, round(coalesce(sum(value) FILTER (hour_idx % 24 BETWEEN 12 AND 17), 0), 4) AS afternoon, round(coalesce(sum(value) FILTER (hour_idx % 24 BETWEEN 20 AND 22), 0), 4) AS late FROM ev GROUP BY 1")
def time_window_sums(spark, d):
    h = F.pmod("hour_idx", F.lit(24))
    spans = {"night": h < 5, "morning": h.between(6, 11), "afternoon": h.between(12, 17), "late": h.between(20, 22)}
    return events(spark, d).groupBy("user_id").agg(*[tidy(F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0)), 4).alias(k) for k, c in spans.items()])


@query("day_night_coupling", f"WITH {EVENTS}, x AS (SELECT user_id, avg(value) FILTER (hour_idx % 24 BETWEEN 6 AND 21) AS a, avg(value) FILTER (hour_idx % 24 < 6 OR hour_idx % 24 = 23) AS b, quantile_cont(value, 0.95) AS p FROM ev GROUP BY 1) SELECT user_id, round(a, 6) AS day_mean, round(b, 6) AS night_mean, round(a / nullif(b, 0), 6) AS coupling, round(p, 6) AS p95 FROM x")
def day_night_coupling(spark, d):
    h = F.pmod("hour_idx", F.lit(24))
    x = events(spark, d).groupBy("user_id").agg(F.avg(F.when(h.between(6, 21), F.col("value"))).alias("a"), F.avg(F.when((h < 6) | (h == 23), F.col("value"))).alias("b"), F.percentile("value", F.lit(0.95)).alias("p"))
    return x.select("user_id", tidy(F.col("a")).alias("day_mean"), tidy(F.col("b")).alias("night_mean"), tidy(ratio(F.col("a"), F.col("b"))).alias("coupling"), tidy(F.col("p")).alias("p95"))


@query("median_around_peak", f"""WITH {EVENTS}, n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev), p AS (SELECT user_id, arg_max(i, struct_pack(v := value, j := -i)) AS pk FROM n GROUP BY 1)
SELECT n.user_id, round(median(value), 6) AS around FROM n JOIN p ON p.user_id = n.user_id AND i BETWEEN greatest(1, pk - 2) AND greatest(1, pk - 2) + 4 GROUP BY 1""")
def median_around_peak(spark, d):
    own = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"])
    a = events(spark, d).groupBy("user_id").agg(own.alias("a")).withColumn("at", F.array_position("a", F.array_max("a")).cast("int"))
    near = F.array_sort(F.slice("a", F.greatest(F.lit(1), F.col("at") - 2), F.lit(5)))
    n = F.size(near)
    middle = (F.element_at(near, F.floor((n + 1) / 2).cast("int")) + F.element_at(near, F.ceil((n + 1) / 2).cast("int"))) / 2
    return a.select("user_id", tidy(middle).alias("around"))


@query("workout_flags", f"WITH {EVENTS} SELECT user_id, count(*) FILTER (channel = 'signup') AS sessions, count(DISTINCT day) FILTER (channel = 'signup') AS active_days, round(coalesce(sum(value) FILTER (channel = 'signup'), 0), 4) AS minutes, bool_or(channel = 'signup' AND value > 120) AS any_long FROM ev GROUP BY 1")
def workout_flags(spark, d):
    own = F.col("channel") == "signup"
    return events(spark, d).groupBy("user_id").agg(F.count_if(own).alias("sessions"), F.countDistinct(F.when(own, F.col("day"))).alias("active_days"), tidy(F.coalesce(F.sum(F.when(own, F.col("value"))), F.lit(0.0)), 4).alias("minutes"), F.bool_or(own & (F.col("value") > 120)).alias("any_long"))


@query("device_sync", f"WITH {EVENTS}, x AS (SELECT user_id, day, coalesce(sum(value) FILTER (channel = 'click'), 0) AS a, coalesce(sum(value) FILTER (channel = 'view'), 0) AS b FROM ev GROUP BY 1, 2) SELECT user_id, round(avg(least(a, b) / nullif(greatest(a, b), 0)), 6) AS sync FROM x GROUP BY 1")
def device_sync(spark, d):
    part = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("value"))), F.lit(0.0))
    x = events(spark, d).groupBy("user_id", "day").agg(part("click").alias("a"), part("view").alias("b"))
    return x.groupBy("user_id").agg(tidy(F.avg(ratio(F.least("a", "b"), F.greatest("a", "b")))).alias("sync"))


@query("intradaily_variability", f"""WITH {EVENTS}, h AS (SELECT user_id, day, hour_idx, sum(value) AS v FROM ev GROUP BY 1, 2, 3), l AS (SELECT user_id, v, v - lag(v) OVER (PARTITION BY user_id ORDER BY hour_idx) AS dv FROM h) SELECT user_id, round(avg(dv * dv) / nullif(var_pop(v), 0), 6) AS variability FROM l GROUP BY 1""")
def intradaily_variability(spark, d):
    h = events(spark, d).groupBy("user_id", "hour_idx").agg(F.sum("value").alias("v"))
    l = h.withColumn("dv", F.col("v") - F.lag("v").over(Window.partitionBy("user_id").orderBy("hour_idx")))
    return l.groupBy("user_id").agg(tidy(ratio(F.avg(F.col("dv") * F.col("dv")), F.var_pop("v"))).alias("variability"))


@query("pooled_moments", f"""WITH {EVENTS}, s AS (SELECT user_id, channel, day, avg(value) AS m, stddev_pop(value) AS sd FROM ev GROUP BY ALL) SELECT user_id, channel, round(avg(m), 6) AS mean, round(avg(sd), 6) AS std, count(*) AS n FROM s GROUP BY 1, 2""")
def pooled_moments(spark, d):
    s = events(spark, d).groupBy("user_id", "channel", "day").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return s.groupBy("user_id", "channel").agg(tidy(F.avg("m")).alias("mean"), tidy(F.avg("sd")).alias("std"), F.count(F.lit(1)).alias("n"))


@query("hour_bitmap", f"WITH {EVENTS}, b AS (SELECT user_id, day, bit_or((1::BIGINT << (hour_idx % 24)::INT)) AS bits FROM ev GROUP BY 1, 2) SELECT user_id, day::VARCHAR AS day, bits, bit_count(bits)::INTEGER AS n_hours FROM b")
def hour_bitmap(spark, d):
    b = events(spark, d).groupBy("user_id", "day").agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(hour_idx, 24) AS INT))")).alias("bits"))
    return b.select("user_id", F.col("day").cast("string").alias("day"), "bits", F.bit_count("bits").alias("n_hours"))


@query("subset_gate", f"WITH {EVENTS}, c AS (SELECT user_id, list(DISTINCT channel) AS c FROM ev WHERE value > 100 GROUP BY 1) SELECT user_id, list_contains(c, 'click') AND list_contains(c, 'view') AS complete FROM c")
def subset_gate(spark, d):
    c = events(spark, d).where("value > 100").groupBy("user_id").agg(F.collect_set("channel").alias("c"))
    return c.select("user_id", (F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "c")) == 0).alias("complete"))


@query("split_ratio_check", f"WITH {EVENTS}, u AS (SELECT DISTINCT user_id FROM ev), s AS (SELECT CASE WHEN user_id % 10 < 6 THEN 'train' WHEN user_id % 10 = 6 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM u GROUP BY 1) SELECT split, n, abs(n / sum(n) OVER () - CASE split WHEN 'train' THEN 0.6 WHEN 'validation' THEN 0.1 ELSE 0.3 END) <= 0.05 AS within FROM s")
def split_ratio_check(spark, d):
    split = F.when(F.col("user_id") % 10 < 6, "train").when(F.col("user_id") % 10 == 6, "validation").otherwise("test")
    s = events(spark, d).select("user_id").distinct().groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))
    want = F.when(F.col("split") == "train", 0.6).when(F.col("split") == "validation", 0.1).otherwise(0.3)
    return s.crossJoin(s.agg(F.sum("n").alias("t"))).select("split", "n", (F.abs(F.col("n") / F.col("t") - want) <= 0.05).alias("within"))  # three rows by one


@query("hash_split", f"WITH {EVENTS}, u AS (SELECT DISTINCT user_id FROM ev), r AS (SELECT user_id, row_number() OVER (ORDER BY {mask_sql("user_id")}, user_id) AS i, count(*) OVER () AS n FROM u) SELECT user_id, CASE WHEN i <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN i <= greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.1)) THEN 'validation' ELSE 'test' END AS split FROM r")
def hash_split(spark, d):
    """Exact shares in hash order: ranks come from counts of the 1000 hash values, not from one global window; a user that is null comes last.

    Shares are decimals, as in the SQL: 0.7 of 90 users are 63, in doubles 62.
    """
    h = F.when(F.col("user_id").isNull(), F.lit(1000)).otherwise(I.mask_hash(F.col("user_id")))
    u = events(spark, d).select("user_id").distinct().withColumn("h", h)
    sizes = u.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 1001 rows at most
    total = sizes.agg(F.sum("c").alias("n"))
    ranked = u.join(before.select("h", "b"), "h").withColumn("i", F.col("b") + F.row_number().over(Window.partitionBy("h").orderBy("user_id"))).crossJoin(total)
    share = lambda tenths: F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(tenths).cast("decimal(2,1)")))
    a, v = share("0.7"), share("0.1")
    return ranked.select("user_id", F.when(F.col("i") <= a, "train").when(F.col("i") <= a + v, "validation").otherwise("test").alias("split"))


@query("metric_directions", f"""WITH {PREDICTIONS}, m AS (SELECT method, channel, avg(abs(gt - pred)) AS mae, avg(((gt > 50) = (pred > 50))::INT) AS accuracy FROM preds GROUP BY 1, 2), x AS (SELECT method, channel, 'mae' AS metric, round(mae, 9) AS key FROM m UNION ALL SELECT method, channel, 'accuracy', -round(accuracy, 9) FROM m)
SELECT method, channel, metric, {_RANKED.format(k="channel, metric", x="key")} AS mean_rank FROM x""")
def metric_directions(spark, d):
    m = predictions(spark, d).groupBy("method", "channel").agg(F.round(F.avg(F.abs(F.col("gt") - F.col("pred"))), 9).alias("mae"), F.round(F.avg(((F.col("gt") > 50) == (F.col("pred") > 50)).cast("int")), 9).alias("accuracy"))
    x = m.unpivot(["method", "channel"], ["mae", "accuracy"], "metric", "value").withColumn("key", F.when(F.col("metric") == "mae", F.col("value")).otherwise(-F.col("value")))
    return x.select("method", "channel", "metric", M.average_rank(["channel", "metric"], F.col("key")).alias("mean_rank"))


@query("task_summary", f"WITH {USER_ERRORS} SELECT method, channel, round(avg(e), 6) AS mean, round(stddev_samp(e) / sqrt(count(*)), 6) AS se, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high, count(*) AS n FROM ue GROUP BY 1, 2")
def task_summary(spark, d):
    q = lambda p: tidy(F.percentile("e", F.lit(p)))
    return user_errors(spark, d).groupBy("method", "channel").agg(tidy(F.avg("e")).alias("mean"), tidy(F.stddev_samp("e") / F.sqrt(F.count(F.lit(1)))).alias("se"), q(0.025).alias("low"), q(0.975).alias("high"), F.count(F.lit(1)).alias("n"))


@query("bootstrap_ranks", f"""WITH {USER_ERRORS}, r AS (SELECT method, channel, user_id, {_RANKED.format(k="channel, user_id", x="round(e, 9)")} AS rk FROM ue), pu AS (SELECT method, user_id, avg(rk) AS v FROM r GROUP BY 1, 2),
dr AS (SELECT method, v, k AS draw, {draw_sql(11, "k", "user_id")} FROM pu, range(0, 50) t(k)) SELECT method, draw::INTEGER AS draw, round(sum({_WEIGHT} * v) / sum({_WEIGHT}), 6) AS mean_rank FROM dr GROUP BY 1, 2
UNION ALL SELECT method, -1, round(avg(v), 6) FROM pu GROUP BY 1""")
def bootstrap_ranks(spark, d):
    """Mean ranks of each draw; draw -1 is the data as it is."""
    ranked = user_errors(spark, d).withColumn("e", F.round("e", 9)).withColumn("rk", M.average_rank(["channel", "user_id"], F.col("e")))
    draws = L.bootstrap(ranked, ["method"], "user_id", "rk", 50, 11).select("method", "draw", F.col("estimate").alias("mean_rank"))
    point = ranked.groupBy("method", "user_id").agg(F.avg("rk").alias("v")).groupBy("method").agg(F.lit(-1).alias("draw"), F.avg("v").alias("mean_rank"))
    return draws.unionByName(point.select("method", "draw", "mean_rank")).withColumn("mean_rank", tidy(F.col("mean_rank")))


@query("bootstrap_skill", f"""WITH {USER_ERRORS}, p AS (SELECT m.method, m.user_id, avg(ln(greatest(0.01, least(100, m.e / b.e))::DOUBLE)) AS v FROM ue m JOIN ue b ON b.method = 'locf' AND b.channel = m.channel AND b.user_id = m.user_id WHERE m.method <> 'locf' AND b.e > 0 GROUP BY 1, 2),
dr AS (SELECT method, v, k AS draw, {draw_sql(13, "k", "user_id")} FROM p, range(0, 50) t(k)) SELECT method, draw::INTEGER AS draw, round(1 - exp(sum({_WEIGHT} * v) / sum({_WEIGHT})), 6) AS skill FROM dr GROUP BY 1, 2""")
def bootstrap_skill(spark, d):
    w = Window.partitionBy("channel", "user_id")
    e = user_errors(spark, d).withColumn("b", F.max(F.when(F.col("method") == "locf", F.col("e"))).over(w)).where("method <> 'locf'")
    logs = e.withColumn("lr", F.log(skill_ratio(F.col("e"), F.col("b"))))
    return L.bootstrap(logs, ["method"], "user_id", "lr", 50, 13).select("method", "draw", tidy(1 - F.exp("estimate")).alias("skill"))


@query("fairness_draws", f"""WITH {USER_ERRORS}, pu AS (SELECT method, user_id, avg(e) AS v FROM ue GROUP BY 1, 2), dr AS (SELECT method, user_id % 5 AS band, v, k AS draw, {draw_sql(17, "k", "user_id")} FROM pu, range(0, 20) t(k)),
g AS (SELECT method, draw, band, sum({_WEIGHT} * v) / nullif(sum({_WEIGHT}), 0) AS e FROM dr GROUP BY ALL) SELECT a.method, a.draw::INTEGER AS draw, round(avg(abs(a.e - b.e)), 6) AS mapd FROM g a JOIN g b ON a.method = b.method AND a.draw = b.draw AND a.band < b.band GROUP BY 1, 2""")
def fairness_draws(spark, d):
    """Disparity between bands in each draw."""
    rows = user_errors(spark, d).withColumn("band", F.col("user_id") % 5)
    groups = L.bootstrap(rows, ["method", "band"], "user_id", "e", 20, 17)
    return L.mapd(groups, ["method", "draw"], "estimate").select("method", "draw", tidy(F.col("mapd")).alias("mapd"))


@query("window_macro_display", f"WITH {PREDICTIONS}, w AS (SELECT method, channel, user_id, hour_idx // 48 AS w, avg(abs(gt - pred)) AS m FROM preds GROUP BY ALL) SELECT method, channel, round(avg(m), 6) AS mae, count(*) AS n_windows FROM w GROUP BY 1, 2")
def window_macro_display(spark, d):
    w = predictions(spark, d).groupBy("method", "channel", "user_id", F.floor(F.col("hour_idx") / 48).alias("w")).agg(F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("m"))
    return w.groupBy("method", "channel").agg(tidy(F.avg("m")).alias("mae"), F.count(F.lit(1)).alias("n_windows"))


@query("table_intensity", f"WITH {USER_ERRORS}, m AS (SELECT method, channel, avg(e) AS e FROM ue GROUP BY 1, 2) SELECT method, channel, round((e - min(e) OVER w) / nullif(max(e) OVER w - min(e) OVER w, 0), 5) + 0.0 AS shade FROM m WINDOW w AS (PARTITION BY channel)")
def table_intensity(spark, d):
    m, w = user_errors(spark, d).groupBy("method", "channel").agg(F.avg("e").alias("e")), Window.partitionBy("channel")
    return m.select("method", "channel", tidy(ratio(F.col("e") - F.min("e").over(w), F.max("e").over(w) - F.min("e").over(w)), 5).alias("shade"))


@query("transpose_arrays", f"WITH {EVENTS}, g AS (SELECT user_id, {CHANNEL_NO} AS c, hour_idx % 24 AS h, sum(value) AS v FROM ev GROUP BY ALL) SELECT user_id, h AS hour, string_agg(round(coalesce(v, 0), 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY n.c) AS channels, count(*) FILTER (v IS NULL) AS n_missing FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN range(0, 24) r(h) CROSS JOIN range(0, 5) n(c) LEFT JOIN g USING (user_id, h, c) GROUP BY 1, 2")
def transpose_arrays(spark, d):
    """Channel-first sums per hour as hour-first rows with their missing flags."""
    code = lookup(CHANNELS, "channel")
    g = events(spark, d).groupBy("user_id", code.alias("c"), F.pmod("hour_idx", F.lit(24)).alias("h")).agg(F.sum("value").alias("v"))
    per = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("h") * 5 + F.col("c")).alias("k"), "v"))).alias("m"))
    hours = per.select("user_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    row = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.try_element_at(F.col("m"), F.col("hour") * 5 + c))
    r = hours.select("user_id", "hour", row.alias("row"))
    return r.select("user_id", "hour", F.array_join(F.transform("row", lambda v: F.coalesce(v, F.lit(0.0)).cast("decimal(18,2)").cast("string")), ",").alias("channels"), F.size(F.filter("row", lambda v: v.isNull())).cast("long").alias("n_missing"))


@query("safe_names", r"SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g') AS safe, split_part(p_name, ' ', 1) AS head, starts_with(p_name, 'small') AS is_small FROM part")
def safe_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower(F.trim("p_name")), "[^a-z0-9]+", "_").alias("safe"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.startswith("p_name", F.lit("small")).alias("is_small"))


@query("age_at_sample", "SELECT o_orderkey, date_part('year', age(o_orderdate::DATE, DATE '1960-05-17' + (o_custkey % 9000)::INT))::INTEGER AS age FROM orders")
def age_at_sample(spark, d):
    birth = F.date_add(F.lit("1960-05-17").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", whole_years(birth, F.col("o_orderdate").cast("date")).alias("age"))


@query("geomean_by_type", "SELECT p_type, round(exp(avg(ln(p_retailprice))), 4) AS price, round(median(p_size), 4)::DOUBLE AS size FROM part WHERE p_retailprice > 0 GROUP BY 1")
def geomean_by_type(spark, d):
    return table(spark, d, "part").where("p_retailprice > 0").groupBy("p_type").agg(tidy(geomean(F.col("p_retailprice")), 4).alias("price"), tidy(F.median("p_size"), 4).alias("size"))


@query("nearest_quantiles_by_brand", "WITH s AS (SELECT p_brand, list(p_retailprice ORDER BY p_retailprice) AS a, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, a[1 + floor(0.1 * (n - 1) + 0.5)::INT] AS q10, a[1 + floor(0.9 * (n - 1) + 0.5)::INT] AS q90 FROM s")
def nearest_quantiles_by_brand(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list("p_retailprice").alias("a"))
    return g.select("p_brand", nearest_quantile(F.col("a"), 0.1).alias("q10"), nearest_quantile(F.col("a"), 0.9).alias("q90"))


@query("nation_macro", "WITH c AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS b FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT r_name, round(avg(b), 4) AS macro, count(*) AS n_nations FROM c JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def nation_macro(spark, d):
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("b"))
    named = per.join(table(spark, d, "nation"), "n_nationkey").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name").agg(tidy(F.avg("b"), 4).alias("macro"), F.count(F.lit(1)).alias("n_nations"))
