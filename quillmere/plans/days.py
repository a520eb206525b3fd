"""Queries over days and users: filters, joins, lookups, calendars, features, scalar functions, event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmere.functions import columns as X
from quillmere.functions.columns import tidy
from quillmere.operators import calendar as C
from quillmere.operators import features as FT
from quillmere.operators import filters as P
from quillmere.operators import impute as I
from quillmere.operators import lookup as J
from quillmere.operators import metrics as M
from quillmere.plans.base import CHANNELS, EVENTS, events, lookup, query, table
from quillmere.streaming import windows as S

DAYS = EVENTS + ", dy AS (SELECT user_id, day, count(*) AS n, sum(value) AS total, 1440 - 240 * count(*) AS nonwear FROM ev GROUP BY 1, 2)"


def days(spark, d):
    return events(spark, d).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), (1440 - 240 * F.count(F.lit(1))).alias("nonwear"))


def text(c: str):
    return F.col(c).cast("string").alias(c)


# -- filters and preprocessing


@query("wear_filter", f"WITH {DAYS} SELECT user_id, day::VARCHAR AS day, nonwear FROM dy WHERE nonwear <= 720")
def wear_filter(spark, d):
    return P.wear_filter(days(spark, d), "nonwear").select("user_id", text("day"), "nonwear")


_VARS = EVENTS + ", vr AS (SELECT user_id, channel, var_pop(value) AS v, count(*) AS n FROM ev GROUP BY 1, 2)"


@query("variance_filter", f"WITH {_VARS} SELECT user_id, count(*) AS n_channels FROM vr GROUP BY 1 HAVING count(*) FILTER (channel IN ('click', 'purchase') AND v < 800) = 0")
def variance_filter(spark, d):
    v = events(spark, d).groupBy("user_id", "channel").agg(F.var_pop("value").alias("v"))
    by = F.map_from_entries(F.collect_list(F.struct(lookup(CHANNELS, "channel").alias("k"), "v")))
    rows = v.groupBy("user_id").agg(by.alias("m"), F.count(F.lit(1)).alias("n_channels")).withColumn("variances", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.try_element_at(F.col("m"), i)))
    return P.variance_filter(rows, "variances", {0: 800.0, 2: 800.0}).select("user_id", "n_channels")


@query("zero_to_missing", f"""WITH {EVENTS}, g AS (SELECT user_id, day, list(CASE WHEN value < 20 THEN 0 ELSE round(value, 2) END ORDER BY event_id) AS a FROM ev GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, len(list_filter(a, lambda x: x <> 0)) AS n_each, CASE WHEN len(list_filter(a, lambda x: x <> 0)) = 0 THEN 0 ELSE len(a) END AS n_whole,
CASE WHEN list_sum(a) < 180 THEN len(list_filter(a, lambda x: x <> 0)) ELSE len(a) END AS n_sleep, CASE WHEN list_sum(a) < 180 AND list_sum(a) > 0 THEN len(list_filter(a, lambda x: x <> 0)) ELSE len(a) END AS n_sleep_strict FROM g""")
def zero_to_missing(spark, d):
    low = F.when(F.col("value") < 20, 0.0).otherwise(F.round("value", 2))
    g = events(spark, d).groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", low.alias("v")))), lambda s: s["v"]).alias("a"))
    left = lambda rule, **k: F.size(F.filter(X.zero_to_missing(F.col("a"), rule, **k), lambda v: v.isNotNull())).cast("long")
    return g.select("user_id", text("day"), left("each").alias("n_each"), left("whole").alias("n_whole"), left("sleep").alias("n_sleep"), left("sleep", strict=True).alias("n_sleep_strict"))


@query("filter_chain_counts", f"WITH {DAYS} SELECT 1 AS step_no, 'wear' AS step, count(*) AS n_before, count(*) FILTER (nonwear <= 720) AS n_after FROM dy UNION ALL SELECT 2, 'total', count(*) FILTER (nonwear <= 720), count(*) FILTER (nonwear <= 720 AND total > 100) FROM dy")
def filter_chain_counts(spark, d):
    return P.filter_chain(days(spark, d), [("wear", F.col("nonwear") <= 720), ("total", F.col("total") > 100)])[1]


@query("eligibility_semijoin", f"WITH {DAYS}, k AS (SELECT DISTINCT user_id, day FROM ev WHERE channel = 'purchase') SELECT user_id, day::VARCHAR AS day, n FROM dy SEMI JOIN k ON dy.user_id = k.user_id AND dy.day = k.day")
def eligibility_semijoin(spark, d):
    allowed = events(spark, d).where("channel = 'purchase'").select("user_id", "day")
    return P.eligible(days(spark, d), allowed, ["user_id", "day"]).select("user_id", text("day"), "n")


@query("cutoff_filter", f"WITH {DAYS}, c AS (SELECT user_id, max(day) + 2 AS cutoff FROM ev WHERE channel = 'signup' GROUP BY 1) SELECT dy.user_id, day::VARCHAR AS day, n FROM dy LEFT JOIN c ON dy.user_id = c.user_id WHERE cutoff IS NULL OR day <= cutoff")
def cutoff_filter(spark, d):
    labels = events(spark, d).where("channel = 'signup'")
    return P.before_cutoff(days(spark, d), P.cutoff_table(labels, "user_id", "day", 2), "user_id", "day").select("user_id", text("day"), "n")


@query("sentinel_unpivot", """WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 5 = 0 THEN -1.0 ELSE c_acctbal END AS balance FROM customer)
SELECT c_custkey, 'nation' AS task, nation::DOUBLE AS label FROM w WHERE nation <> -1 UNION ALL SELECT c_custkey, 'balance', balance FROM w WHERE balance <> -1""")
def sentinel_unpivot(spark, d):
    w = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 5 == 0, -1.0).otherwise(F.col("c_acctbal")).alias("balance"))
    clean = w.select("c_custkey", *[X.sentinel_to_null(F.col(c)).cast("double").alias(c) for c in ("nation", "balance")])
    return clean.unpivot("c_custkey", ["nation", "balance"], "task", "label").where("label IS NOT NULL")


@query("channel_merge", f"WITH {EVENTS} SELECT user_id, day::VARCHAR AS day, CASE channel WHEN 'view' THEN 'click' ELSE channel END AS channel, round(avg(value), 6) AS v FROM ev GROUP BY ALL")
def channel_merge(spark, d):
    return P.merge_channels(events(spark, d), {"view": "click"}, ["user_id", "day"], value="value").select("user_id", text("day"), "channel", tidy(F.col("value")).alias("v"))


@query("metric_to_error", "SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 AND x BETWEEN 0 AND 1 THEN greatest(1 - x, 0.005) WHEN doc_id % 2 = 1 AND x >= 0 THEN x END, 6)::DOUBLE AS error FROM (SELECT doc_id, n_chars / 4000.0::DOUBLE AS x FROM documents)")
def metric_to_error(spark, d):
    return table(spark, d, "documents").select("doc_id", tidy(X.metric_to_error(F.col("n_chars") / 4000.0, F.col("doc_id") % 2 == 0)).alias("error"))


# -- joins and sets


@query("split_assign", f"WITH {EVENTS} SELECT CASE WHEN user_id % 10 < 6 THEN 'train' WHEN user_id % 10 = 6 THEN 'validation' ELSE 'test' END AS split, count(DISTINCT user_id) AS n_users, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ev GROUP BY 1")
def split_assign(spark, d):
    split = F.when(F.col("user_id") % 10 < 6, "train").when(F.col("user_id") % 10 == 6, "validation").otherwise("test")
    per = events(spark, d).groupBy(split.alias("split")).agg(F.countDistinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_rows"))
    return per.crossJoin(per.agg(F.sum("n_rows").alias("all"))).select("split", "n_users", "n_rows", tidy(F.col("n_rows") / F.col("all")).alias("share"))  # three rows by one


@query("cohort_intersect", f"WITH {EVENTS}, k AS (SELECT DISTINCT user_id, channel FROM ev WHERE value > 100), c AS (SELECT user_id FROM k GROUP BY 1 HAVING count(*) = 5) SELECT channel, count(*) AS n_users FROM k SEMI JOIN c ON k.user_id = c.user_id GROUP BY 1")
def cohort_intersect(spark, d):
    k = events(spark, d).where("value > 100").select("user_id", "channel").distinct()
    full = k.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n = 5")
    return k.join(full, "user_id", "left_semi").groupBy("channel").agg(F.count(F.lit(1)).alias("n_users"))


@query("feature_full_join", f"""WITH {EVENTS}, a AS (SELECT user_id, sum(value) AS clicks FROM ev WHERE channel = 'click' AND value > 100 GROUP BY 1), b AS (SELECT user_id, max(value) AS top FROM ev WHERE channel = 'purchase' AND value > 100 GROUP BY 1), c AS (SELECT user_id, count(*) AS errors FROM ev WHERE channel = 'error' AND value > 100 GROUP BY 1)
SELECT user_id, round(clicks, 4) AS clicks, top, errors::DOUBLE AS errors FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)""")
def feature_full_join(spark, d):
    e = events(spark, d).where("value > 100")
    a, b, c = (e.where(F.col("channel") == n).groupBy("user_id").agg(agg) for n, agg in (("click", tidy(F.sum("value"), 4).alias("clicks")), ("purchase", F.max("value").alias("top")), ("error", F.count(F.lit(1)).cast("double").alias("errors"))))
    return a.join(b, "user_id", "full").join(c, "user_id", "full")


@query("asof_nearest", f"""WITH {EVENTS}, q AS (SELECT event_id, user_id, ts FROM ev WHERE channel = 'purchase'), s AS (SELECT user_id, ts AS sts, min(value) AS v FROM ev WHERE channel = 'signup' GROUP BY 1, 2)
SELECT q.event_id, q.user_id, m.v AS match_value, strftime(m.sts, '%Y-%m-%d %H:%M:%S') AS match_ts FROM q LEFT JOIN (SELECT q.event_id, arg_min(struct_pack(v := s.v, sts := s.sts), struct_pack(a := abs(epoch_us(s.sts) - epoch_us(q.ts)), b := s.sts)) AS m FROM q JOIN s ON q.user_id = s.user_id GROUP BY 1) x ON q.event_id = x.event_id""")
def asof_nearest(spark, d):
    e = events(spark, d)
    got = J.asof_nearest(e.where("channel = 'purchase'").select("event_id", "user_id", "ts"), e.where("channel = 'signup'").select("user_id", F.col("ts").alias("sts"), "value"), "user_id", "ts", "sts", "value")
    return got.select("event_id", "user_id", "match_value", F.date_format("match_ts", "yyyy-MM-dd HH:mm:ss").alias("match_ts"))


@query("asof_valid", f"""WITH {EVENTS}, q AS (SELECT event_id, user_id, ts FROM ev WHERE channel = 'purchase'), s AS (SELECT user_id, ts AS sts, min(value) AS v FROM ev WHERE channel = 'signup' AND value >= 50 GROUP BY 1, 2)
SELECT q.event_id, x.m.v AS match_value FROM q LEFT JOIN (SELECT q.event_id, arg_min(struct_pack(v := s.v, sts := s.sts), struct_pack(a := abs(epoch_us(s.sts) - epoch_us(q.ts)), b := s.sts)) AS m FROM q JOIN s ON q.user_id = s.user_id GROUP BY 1) x ON q.event_id = x.event_id""")
def asof_valid(spark, d):
    e = events(spark, d)
    series = e.where("channel = 'signup'").select("user_id", F.col("ts").alias("sts"), F.when(F.col("value") >= 50, F.col("value")).alias("value"))
    return J.asof_nearest(e.where("channel = 'purchase'").select("event_id", "user_id", "ts"), series, "user_id", "ts", "sts", "value").select("event_id", "match_value")


@query("range_window_agg", f"""WITH {EVENTS}, q AS (SELECT event_id, user_id, ts FROM ev WHERE channel = 'purchase'), s AS (SELECT user_id, ts AS sts, value AS v FROM ev WHERE channel = 'signup')
SELECT q.event_id, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, min(v) AS low, max(v) AS high, round(stddev_samp(v), 6) AS sd, arg_min(v, sts) AS first_value, arg_max(v, sts) AS last_value
FROM q JOIN s ON q.user_id = s.user_id AND s.sts BETWEEN q.ts - INTERVAL 3 DAY AND q.ts + INTERVAL 3 DAY GROUP BY 1""")
def range_window_agg(spark, d):
    e = events(spark, d)
    pairs = J.range_pairs(e.where("channel = 'purchase'").select("event_id", "user_id", "ts"), e.where("channel = 'signup'").select("user_id", F.col("ts").alias("sts"), F.col("value").alias("v")), "user_id", "ts", "sts", 3)
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("v")).alias("mean"), tidy(F.median("v")).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"), tidy(F.stddev_samp("v")).alias("sd"), F.min_by("v", "sts").alias("first_value"), F.max_by("v", "sts").alias("last_value"))


@query("interval_lookup", f"""WITH {EVENTS}, i AS (SELECT user_id, event_id AS name, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - INTERVAL 1 HOUR AS fin FROM ev WHERE channel = 'signup'), q AS (SELECT event_id, user_id, ts FROM ev WHERE channel = 'purchase')
SELECT q.event_id, coalesce(i.name, -1) AS interval_name FROM q LEFT JOIN i ON q.user_id = i.user_id AND (i.fin IS NULL OR i.fin >= i.start) AND q.ts >= i.start AND (i.fin IS NULL OR q.ts <= i.fin)""")
def interval_lookup(spark, d):
    e = events(spark, d)
    got = J.interval_lookup(e.where("channel = 'purchase'").select("event_id", "user_id", "ts"), J.intervals_from_events(e.where("channel = 'signup'"), "user_id", "ts", "event_id", "INTERVAL 1 HOUR"), "user_id", "ts")
    return got.select("event_id", F.coalesce("interval_name", F.lit(-1)).alias("interval_name"))


@query("interval_overlap_check", f"""WITH {EVENTS}, i AS (SELECT user_id, event_id, ts AS s, ts + to_minutes((value * 20)::INT) AS e FROM ev WHERE channel = 'signup'), p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM i) SELECT event_id, user_id FROM p WHERE s <= pe""")
def interval_overlap_check(spark, d):
    rows = events(spark, d).where("channel = 'signup'").select("user_id", "event_id", F.col("ts").alias("start"), F.expr("timestampadd(MINUTE, CAST(round(value * 20) AS INT), ts)").alias("end"))
    return J.interval_overlaps(rows, "user_id").select("event_id", "user_id")


@query("precedence_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS v FROM supplier GROUP BY 1) b ON a.k = b.k")
def precedence_merge(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(tidy(F.avg("c_acctbal"), 4).alias("v"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(tidy(F.avg("s_acctbal"), 4).alias("v"))
    return J.merge_by_precedence(a, b, ["k"], "v")


@query("demographic_join", f"WITH {EVENTS} SELECT coalesce(c_mktsegment, 'unknown') AS segment, count(*) AS n, count(DISTINCT user_id) AS n_users FROM ev LEFT JOIN customer c ON c_custkey = user_id GROUP BY 1")
def demographic_join(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return events(spark, d).join(who, "user_id", "left").groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("set_operations", f"""WITH {EVENTS}, a AS (SELECT DISTINCT user_id FROM ev WHERE channel = 'click' AND value > 100), b AS (SELECT DISTINCT user_id FROM ev WHERE channel = 'view' AND value > 100)
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_operations(spark, d):
    e = events(spark, d).where("value > 100")
    a, b = (e.where(F.col("channel") == c).select("user_id").distinct() for c in ("click", "view"))
    ops = {"intersect": a.intersect(b), "except": a.exceptAll(b), "union": a.union(b).distinct()}
    out = [f.agg(F.lit(k).alias("op"), F.count(F.lit(1)).alias("n")) for k, f in ops.items()]
    return out[0].union(out[1]).union(out[2])


@query("best_per_task", "SELECT p_brand, arg_max(p_name, struct_pack(a := p_retailprice, b := -p_partkey)) AS best, max(p_retailprice) AS price FROM part GROUP BY 1")
def best_per_task(spark, d):
    order = F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_name", order).alias("best"), F.max("p_retailprice").alias("price"))


@query("wide_summary", "SELECT p_brand, round(avg(p_retailprice) FILTER (p_size <= 10), 4) AS small, round(avg(p_retailprice) FILTER (p_size BETWEEN 11 AND 30), 4) AS medium, round(avg(p_retailprice) FILTER (p_size > 30), 4) AS large FROM part GROUP BY 1")
def wide_summary(spark, d):
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return table(spark, d, "part").withColumn("s", size).groupBy("p_brand").pivot("s", ["small", "medium", "large"]).agg(tidy(F.avg("p_retailprice"), 4))


# -- calendars


@query("window_index", f"""WITH {EVENTS}, x AS (SELECT DISTINCT user_id, day FROM ev), r AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM x GROUP BY 1), w AS (SELECT user_id, unnest(generate_series(0, (hi - lo - 6) // 3)) * 3 AS o, lo FROM r WHERE hi - lo >= 6)
SELECT w.user_id, (lo + o::INT)::VARCHAR AS window_start, count(*) AS n_days, string_agg((day - lo - o)::VARCHAR, ',' ORDER BY day) AS day_offsets FROM w JOIN x ON x.user_id = w.user_id AND day BETWEEN lo + o::INT AND lo + o::INT + 6 GROUP BY w.user_id, lo, o HAVING count(*) >= 5""")
def window_index(spark, d):
    got = C.window_index(events(spark, d), "user_id", "day", 7, 3, 5)
    return got.select("user_id", text("window_start"), "n_days", F.array_join(F.transform("day_offsets", lambda x: x.cast("string")), ",").alias("day_offsets"))


@query("weekly_coverage", f"WITH {EVENTS}, h AS (SELECT user_id, day, count(DISTINCT hour_idx) AS hours FROM ev GROUP BY 1, 2) SELECT user_id, date_diff('day', DATE '2024-01-01', day) // 7 AS week, sum(hours)::BIGINT AS n_valid_hours, count(*) FILTER (hours >= 3) AS n_valid_days FROM h GROUP BY 1, 2")
def weekly_coverage(spark, d):
    h = events(spark, d).groupBy("user_id", "day").agg(F.countDistinct("hour_idx").alias("hours"))
    week = F.floor(F.datediff("day", F.lit("2024-01-01").cast("date")) / 7).cast("long")
    return h.groupBy("user_id", week.alias("week")).agg(F.sum("hours").alias("n_valid_hours"), F.count_if(F.col("hours") >= 3).alias("n_valid_days"))


_DAILY = EVENTS + ", dv AS (SELECT user_id, date_diff('day', DATE '2024-01-01', day) AS dn, sum(value) AS v FROM ev GROUP BY 1, 2)"


def _daily(spark, d):
    return events(spark, d).groupBy("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("dn")).agg(F.sum("value").alias("v"))


@query("gap_fill_series", f"WITH {_DAILY}, r AS (SELECT user_id, unnest(generate_series(min(dn), max(dn))) AS dn FROM dv GROUP BY 1) SELECT r.user_id, r.dn, round(v, 6) AS v FROM r LEFT JOIN dv ON r.user_id = dv.user_id AND r.dn = dv.dn")
def gap_fill_series(spark, d):
    return C.gap_fill(_daily(spark, d), ["user_id"], "dn", "v").select("user_id", "dn", tidy(F.col("v")).alias("v"))


@query("tail_window", f"WITH {_DAILY}, m AS (SELECT user_id, max(dn) AS hi FROM dv GROUP BY 1), g AS (SELECT user_id, p AS position, hi - 9 + p AS dn FROM m, range(0, 10) r(p)) SELECT g.user_id, g.position::INTEGER AS position, g.dn, round(coalesce(v, 0), 6) AS v, (v IS NULL)::INTEGER AS missing FROM g LEFT JOIN dv ON g.user_id = dv.user_id AND g.dn = dv.dn")
def tail_window(spark, d):
    return C.tail_window(_daily(spark, d), ["user_id"], "dn", "v", 10).withColumn("v", tidy(F.col("v")))


@query("observed_day_chunks", f"""WITH {EVENTS}, x AS (SELECT DISTINCT user_id, day FROM ev), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY day) - 1) // 5 AS chunk FROM x)
SELECT user_id, chunk, min(day)::VARCHAR AS first_day, count(*) AS n_days, 5 - count(*) AS n_padding, max(day) - min(day) AS span FROM c GROUP BY 1, 2""")
def observed_day_chunks(spark, d):
    got = C.observed_chunks(events(spark, d), "user_id", "day", 5)
    return got.select("user_id", "chunk", text("first_day"), "n_days", "n_padding", F.array_max("day_offsets").cast("long").alias("span"))


@query("day_profile", f"WITH {EVENTS}, h AS (SELECT user_id, hour_idx % 24 AS h, sum(value) AS v FROM ev GROUP BY 1, 2) SELECT user_id, string_agg(round(coalesce(v, 0), 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY g.h) AS profile FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN range(0, 24) g(h) LEFT JOIN h USING (user_id, h) GROUP BY 1")
def day_profile(spark, d):
    got = FT.day_profile(events(spark, d), ["user_id"], F.pmod("hour_idx", F.lit(24)), "value")
    return got.select("user_id", F.array_join(F.transform("profile", lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("profile"))


# -- features


@query("daily_sums_quantiles", f"""WITH {DAYS}, s AS (SELECT user_id, list(total ORDER BY total) AS a, count(*) AS n FROM dy GROUP BY 1)
SELECT user_id, n, round(a[1 + floor(0.05 * (n - 1) + 0.5)::INT], 4) AS q05, round(a[1 + floor(0.25 * (n - 1) + 0.5)::INT], 4) AS q25, round(a[1 + floor(0.75 * (n - 1) + 0.5)::INT], 4) AS q75, round(a[1 + floor(0.95 * (n - 1) + 0.5)::INT], 4) AS q95, round(a[1 + floor(0.75 * (n - 1) + 0.5)::INT] - a[1 + floor(0.25 * (n - 1) + 0.5)::INT], 4) AS iqr, round(list_median(a), 4) AS median FROM s""".replace("list_median(a)", "list_aggregate(a, 'median')"))
def daily_sums_quantiles(spark, d):
    g = days(spark, d).groupBy("user_id").agg(F.collect_list("total").alias("a"), F.count(F.lit(1)).alias("n"), F.median("total").alias("m"))
    q = lambda p: X.nearest_quantile(F.col("a"), p)
    return g.select("user_id", "n", *[tidy(q(p), 4).alias(k) for k, p in (("q05", 0.05), ("q25", 0.25), ("q75", 0.75), ("q95", 0.95))], tidy(q(0.75) - q(0.25), 4).alias("iqr"), tidy(F.col("m"), 4).alias("median"))


@query("conditional_medians", f"WITH {DAYS} SELECT user_id, round(median(total) FILTER (isodow(day) >= 6), 4) AS weekend, round(median(total) FILTER (isodow(day) < 6), 4) AS weekday, round(median(total) FILTER (isodow(day) >= 6) - median(total) FILTER (isodow(day) < 6), 4) + 0.0 AS shift FROM dy GROUP BY 1")
def conditional_medians(spark, d):
    g = days(spark, d).withColumn("w", FT.weekend(F.col("day"))).groupBy("user_id").agg(F.median(F.when(F.col("w"), F.col("total"))).alias("a"), F.median(F.when(~F.col("w"), F.col("total"))).alias("b"))
    return g.select("user_id", tidy(F.col("a"), 4).alias("weekend"), tidy(F.col("b"), 4).alias("weekday"), tidy(F.col("a") - F.col("b"), 4).alias("shift"))


@query("ever_flags", f"WITH {EVENTS} SELECT user_id, bool_or(channel = 'error' AND value > 200) AS ever_high_error, round(avg((value > 50)::INT), 6) AS share_high, count(DISTINCT channel) AS n_channels FROM ev GROUP BY 1")
def ever_flags(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.bool_or((F.col("channel") == "error") & (F.col("value") > 200)).alias("ever_high_error"), tidy(F.avg((F.col("value") > 50).cast("int"))).alias("share_high"), F.countDistinct("channel").alias("n_channels"))


@query("intensity_zones", f"WITH {EVENTS} SELECT user_id, day::VARCHAR AS day, count(*) FILTER (value < 10) AS rest, count(*) FILTER (value >= 10 AND value < 40) AS light, count(*) FILTER (value >= 40 AND value < 80) AS moderate, count(*) FILTER (value >= 80) AS vigorous FROM ev GROUP BY 1, 2")
def intensity_zones(spark, d):
    v = F.col("value")
    zones = {"rest": v < 10, "light": (v >= 10) & (v < 40), "moderate": (v >= 40) & (v < 80), "vigorous": v >= 80}
    return events(spark, d).groupBy("user_id", "day").agg(*[F.count_if(c).alias(k) for k, c in zones.items()]).select("user_id", text("day"), *zones)


@query("efficiency_ratio", f"WITH {EVENTS}, x AS (SELECT user_id, day, sum(value) FILTER (channel = 'view') AS a, sum(value) FILTER (channel = 'click') AS b FROM ev GROUP BY 1, 2) SELECT user_id, day::VARCHAR AS day, round(CASE WHEN b >= 50 AND a / b <= 1.5 THEN a / b END, 6) AS ratio FROM x")
def efficiency_ratio(spark, d):
    x = events(spark, d).groupBy("user_id", "day").agg(F.sum(F.when(F.col("channel") == "view", F.col("value"))).alias("a"), F.sum(F.when(F.col("channel") == "click", F.col("value"))).alias("b"))
    r = X.ratio(F.col("a"), F.col("b"))
    return x.select("user_id", text("day"), tidy(F.when((F.col("b") >= 50) & (r <= 1.5), r)).alias("ratio"))


@query("rmssd", f"WITH {DAYS}, l AS (SELECT user_id, total - lag(total) OVER (PARTITION BY user_id ORDER BY day) AS df FROM dy) SELECT user_id, round(sqrt(avg(df * df)), 6) AS rmssd FROM l GROUP BY 1")
def rmssd(spark, d):
    return FT.rmssd(days(spark, d), "user_id", ["day"], "total").withColumn("rmssd", tidy(F.col("rmssd")))


@query("moments", f"""WITH {EVENTS} SELECT channel, count(value) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(var_pop(value), 5) AS variance, round(stddev_pop(value), 6) AS deviation, round(avg(value * value), 5) AS power, max(abs(value)) AS peak, round(max(value) - min(value), 6) AS peak_to_peak,
round(max(abs(value)) / sqrt(avg(value * value)), 6) AS crest, round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3, 4) AS skew, round(kurtosis_pop(value), 4) AS kurt FROM ev GROUP BY 1""")
def moments(spark, d):
    got = events(spark, d).groupBy("channel").agg(*FT.moments("value"))
    digits = {"variance": 5, "power": 5, "skew": 4, "kurt": 4}
    return got.select("channel", "n", "peak", *[tidy(F.col(c), digits.get(c, 6)).alias(c) for c in ("rms", "variance", "deviation", "power", "peak_to_peak", "crest", "skew", "kurt")])


@query("interdaily_stability", f"""WITH {EVENTS}, h AS (SELECT user_id, hour_idx % 24 AS h, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM ev GROUP BY 1, 2)
SELECT user_id, round((avg((s / n) ** 2) - avg(s / n) ** 2) / nullif(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2, 0), 6) AS stability FROM h GROUP BY 1""")
def interdaily_stability(spark, d):
    return FT.interdaily_stability(events(spark, d), "user_id", F.pmod("hour_idx", F.lit(24)), "value").withColumn("stability", tidy(F.col("stability")))


_PROFILE = EVENTS + """, h AS (SELECT user_id, hour_idx % 24 AS h, sum(value) AS v FROM ev GROUP BY 1, 2), g AS (SELECT user_id, r.h, coalesce(v, 0) AS v FROM (SELECT DISTINCT user_id FROM ev) CROSS JOIN range(0, 24) r(h) LEFT JOIN h USING (user_id, h)),
z AS (SELECT a.user_id, a.h, sum(b.v) FILTER ((b.h - a.h + 24) % 24 < 5) AS l5, sum(b.v) FILTER ((b.h - a.h + 24) % 24 < 10) AS m10 FROM g a JOIN g b ON a.user_id = b.user_id GROUP BY 1, 2)"""


@query("npcra", f"WITH {_PROFILE} SELECT user_id, round(min(l5) / 5, 6) AS l5, round(max(m10) / 10, 6) AS m10, round((max(m10) / 10 - min(l5) / 5) / (max(m10) / 10 + min(l5) / 5), 6) AS relative_amplitude FROM z GROUP BY 1")
def npcra(spark, d):
    got = FT.day_profile(events(spark, d), ["user_id"], F.pmod("hour_idx", F.lit(24)), "value")
    c = FT.circadian(F.col("profile"))
    return got.select("user_id", *[tidy(c[k]).alias(k) for k in ("l5", "m10", "relative_amplitude")])


@query("acrophase", f"WITH {_PROFILE} SELECT user_id, arg_max(h, struct_pack(a := v, b := -h)) AS acrophase FROM g GROUP BY 1 HAVING sum(v) > 0")
def acrophase(spark, d):
    """Hours are compared bit by bit, so they are added up in the order of the table, as the SQL does on one thread."""
    got = FT.day_profile(events(spark, d).where("user_id IS NOT NULL"), ["user_id"], F.pmod("hour_idx", F.lit(24)), "value", order=["event_id"])
    return got.select("user_id", FT.circadian(F.col("profile"))["acrophase"].cast("long").alias("acrophase")).where("acrophase IS NOT NULL")


@query("cosinor", f"""WITH {EVENTS}, b AS (SELECT user_id, cos((hour_idx % 24) * 2 * pi() / 24) AS c, sin((hour_idx % 24) * 2 * pi() / 24) AS s, value AS y FROM ev),
m AS (SELECT user_id, count(*) AS n, avg(c) AS c, avg(s) AS s, avg(y) AS y, covar_pop(c, c) AS vcc, covar_pop(s, s) AS vss, covar_pop(c, s) AS vcs, covar_pop(c, y) AS vcy, covar_pop(s, y) AS vsy, var_pop(y) AS vyy FROM b GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT *, (vcy * vss - vsy * vcs) / (vcc * vss - vcs * vcs) AS be, (vsy * vcc - vcy * vcs) / (vcc * vss - vcs * vcs) AS ga FROM m)
SELECT user_id, n, round(y - be * c - ga * s, 4) AS mesor, round(sqrt(be ** 2 + ga ** 2), 4) AS amplitude, round((be * vcy + ga * vsy) / vyy, 5) AS r2 FROM f""")
def cosinor(spark, d):
    got = FT.cosinor(events(spark, d), ["user_id"], F.pmod("hour_idx", F.lit(24)), "value")
    return got.select("user_id", "n", tidy(F.col("mesor"), 4).alias("mesor"), tidy(F.col("amplitude"), 4).alias("amplitude"), tidy(F.col("r2"), 5).alias("r2"))


@query("cross_correlation", f"""WITH {EVENTS}, w AS (SELECT user_id, day, sum(value) AS x, count(*)::DOUBLE AS y FROM ev GROUP BY 1, 2), z AS (SELECT user_id, day, x - avg(x) OVER u AS x, y - avg(y) OVER u AS y FROM w WINDOW u AS (PARTITION BY user_id)),
l AS (SELECT user_id, x, y, y AS y0, lead(y, 1) OVER o AS y1, lead(y, 2) OVER o AS y2 FROM z WINDOW o AS (PARTITION BY user_id ORDER BY day)),
k AS (SELECT user_id, count(*) AS n, stddev_pop(x) * stddev_pop(y) AS sd, sum(x * y0) AS s0, sum(x * y1) AS s1, sum(x * y2) AS s2 FROM l GROUP BY 1)
SELECT user_id, lag::INTEGER AS lag, round(s / n / nullif(sd, 0), 6) AS ccf FROM (SELECT user_id, n, sd, unnest([0, 1, 2]) AS lag, unnest([s0, s1, s2]) AS s FROM k)""")
def cross_correlation(spark, d):
    w = events(spark, d).groupBy("user_id", "day").agg(F.sum("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return FT.cross_correlation(w, "user_id", "day", "x", "y", 2).withColumn("ccf", tidy(F.col("ccf")))


@query("percentile_rank_merge", "WITH t AS (SELECT lang, doc_id, n_chars, CASE WHEN doc_id % 4 > 0 THEN n_chars END AS p FROM documents WHERE lang IS NOT NULL), r AS (SELECT *, (rank() OVER (PARTITION BY lang, p IS NULL ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, p IS NULL, n_chars) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY lang, p IS NULL) AS pr FROM t) SELECT doc_id, lang, p IS NULL AS fallback, round(pr, 6) AS score FROM r")
def percentile_rank_merge(spark, d):
    t = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "n_chars", (F.col("doc_id") % 4 == 0).alias("fallback"))
    keys = ["lang", "fallback"]
    score = M.average_rank(keys, F.col("n_chars")) / F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return t.select("doc_id", "lang", "fallback", tidy(score).alias("score"))


@query("scatter_mean", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::INTEGER AS pos, round(avg(v), 6) + 0.0 AS m FROM e GROUP BY 1, 2")
def scatter_mean(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", "pos").agg(tidy(F.avg(F.col("v").cast("double"))).alias("m"))


# -- scalar functions


@query("json_props", f"WITH {EVENTS} SELECT channel, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total, max((props::JSON ->> 'k')::BIGINT) AS top, count(*) AS n FROM ev GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return events(spark, d).withColumn("k", k).groupBy("channel").agg(F.sum("k").alias("total"), F.max("k").alias("top"), F.count(F.lit(1)).alias("n"))


@query("multi_select", f"WITH {EVENTS}, s AS (SELECT user_id, list(DISTINCT channel) AS c FROM ev WHERE value > 150 GROUP BY 1) SELECT user_id, len(c) AS n_selected, list_contains(c, 'click') AS has_click, list_contains(c, 'error') AS has_error, list_contains(c, 'view') AS has_view FROM s")
def multi_select(spark, d):
    s = events(spark, d).where("value > 150").groupBy("user_id").agg(F.collect_set("channel").alias("c"))
    hot = X.one_hot(F.col("c"), ["click", "error", "view"])
    return s.select("user_id", F.size("c").cast("long").alias("n_selected"), *[v.alias(f"has_{k}") for k, v in hot.items()])


@query("age_bins", "WITH a AS (SELECT o_custkey, min(o_orderdate)::DATE AS b FROM orders GROUP BY 1), y AS (SELECT o_custkey, date_part('year', age(DATE '2020-06-01', b - INTERVAL 20 YEAR))::INT AS age FROM a) SELECT CASE WHEN age < 18 THEN 'unknown' WHEN age < 30 THEN '18-29' WHEN age < 40 THEN '30-39' WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' ELSE '60+' END AS band, count(*) AS n FROM y GROUP BY 1")
def age_bins(spark, d):
    b = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("b"))
    years = X.whole_years(F.add_months("b", -240), F.lit("2020-06-01").cast("date"))
    return b.groupBy(X.age_band(years).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("label_statistics", f"WITH {EVENTS} SELECT channel, min(value) AS low, max(value) AS high, round(median(value), 6) AS median, count(DISTINCT value) AS n_unique FROM ev GROUP BY 1")
def label_statistics(spark, d):
    return events(spark, d).groupBy("channel").agg(F.min("value").alias("low"), F.max("value").alias("high"), tidy(F.median("value")).alias("median"), F.countDistinct("value").alias("n_unique"))


@query("type_enforcement", "SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END)::VARCHAR AS flag, (CASE WHEN doc_id % 2 = 0 THEN n_chars END)::DOUBLE AS whole FROM documents")
def type_enforcement(spark, d):
    docs = table(spark, d, "documents")
    token = F.element_at(F.array(F.lit("Yes"), F.lit(" false "), F.lit("maybe")), (F.col("doc_id") % 3 + 1).cast("int"))
    number = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("n_chars").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
    return docs.select("doc_id", X.enforce_bool(token).cast("string").alias("flag"), X.enforce_int(number).cast("double").alias("whole"))


@query("seed_hash", "SELECT n_nationkey, (('0x' || substr(sha256('s|' || n_name), 1, 8))::BIGINT & 2147483647) AS seed FROM nation")
def seed_hash(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.seed_of(F.lit("s"), F.col("n_name")).alias("seed"))


# -- event time


@query("tumbling_window", f"WITH {EVENTS} SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, channel, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2")
def tumbling_window(spark, d):
    return _stamped(S.tumbling(events(spark, d), "6 hours", ["channel"])).select("window_start", "channel", "n", "total")


@query("sliding_window", f"WITH {EVENTS}, x AS (SELECT channel, value, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS w FROM ev) SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, channel, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1, 2")
def sliding_window(spark, d):
    return _stamped(S.sliding(events(spark, d), "12 hours", "6 hours", ["channel"])).select("window_start", "channel", "n", "total")


@query("session_window", f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_window(spark, d):
    return _stamped(S.sessions(events(spark, d), "4 hours", ["user_id"])).select("user_id", "window_start", "n", "total")


def _stamped(frame):
    return frame.withColumn("window_start", F.date_format(F.col("window_start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm")).withColumn("total", tidy(F.col("total"), 4))
