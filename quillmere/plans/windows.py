"""Queries over windows of days, ranks over domains, and small filters of day tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions.columns import tidy
from quillmere.operators import calendar as C
from quillmere.operators import features as FT
from quillmere.operators import filters as P
from quillmere.operators import labels as LB
from quillmere.operators import leaderboard as L
from quillmere.operators import windows as W
from quillmere.plans.base import CATEGORY, CATEGORY_SQL, CELLS, EVENTS, USER_ERRORS, cells, events, lookup, query, table, user_errors
from quillmere.plans.days import _DAILY, DAYS, _daily, days, text
from quillmere.plans.tracks import _RANKED

METHODS = ["hourly", "linear", "locf", "mean"]


@query("weekend_flag", f"WITH {DAYS} SELECT user_id, day::VARCHAR AS day, (dayofweek(day) IN (0, 6))::INTEGER AS weekend FROM dy")
def weekend_flag(spark, d):
    return days(spark, d).select("user_id", text("day"), FT.weekend(F.col("day")).cast("int").alias("weekend"))


@query("drop_prefixed", f"WITH {DAYS} SELECT user_id, day::VARCHAR AS day, nonwear FROM dy")
def drop_prefixed(spark, d):
    named = days(spark, d).select("user_id", text("day"), F.col("n").alias("n_events"), F.col("total").alias("total_value"), "nonwear")
    return LB.without_prefixes(named, ("n_", "total_"))


@query("first_samples", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_samples(spark, d):
    """The first samples by their number: here the limit is the operator."""
    return P.first_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 100, "o_orderkey")


@query("forward_fill", f"""WITH {_DAILY}, r AS (SELECT user_id, unnest(generate_series(min(dn), max(dn))) AS dn FROM dv GROUP BY 1), g AS (SELECT r.user_id, r.dn, CASE WHEN v >= 60 THEN v END AS v FROM r LEFT JOIN dv ON r.user_id = dv.user_id AND r.dn = dv.dn),
f AS (SELECT user_id, dn, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, arg_min(v, dn) FILTER (v IS NOT NULL) OVER (PARTITION BY user_id) AS b FROM g)
SELECT user_id, dn, round(coalesce(a, b, 0), 6) AS v FROM f""")
def forward_fill(spark, d):
    own = C.gap_fill(_daily(spark, d), ["user_id"], "dn", "v").withColumn("v", F.when(F.col("v") >= 60, F.col("v")))
    return W.fill_forward(own, ["user_id"], "dn", "v").select("user_id", "dn", tidy(F.col("v")).alias("v"))


@query("domain_rank", f"""WITH {USER_ERRORS}, r AS (SELECT method, channel, user_id, round(e, 9) AS e FROM ue), k AS (SELECT *, {_RANKED.format(k="channel, user_id", x="e")} AS rk FROM r), t AS (SELECT method, channel, avg(rk) AS rk FROM k GROUP BY 1, 2),
c AS (SELECT method, {CATEGORY_SQL} AS domain, avg(rk) AS rk FROM t GROUP BY 1, 2) SELECT method, round(avg(rk), 6) AS mean_rank, count(*) AS n_domains FROM c GROUP BY 1""")
def domain_rank(spark, d):
    """Mean ranks of tasks, averaged in their domain, then over domains."""
    per = L.mean_ranks(user_errors(spark, d).withColumn("e", F.round("e", 9)), ["channel"]).withColumn("domain", lookup(CATEGORY, "channel"))
    domains = per.groupBy("method", "domain").agg(F.avg("mean_rank").alias("rk"))
    return domains.groupBy("method").agg(tidy(F.avg("rk")).alias("mean_rank"), F.count(F.lit(1)).alias("n_domains"))


@query("stacked_ranks", f"""WITH {USER_ERRORS}, r AS (SELECT method, channel, user_id, round(e, 9) AS e FROM ue WHERE e < 60), k AS (SELECT *, {_RANKED.format(k="channel, user_id", x="e")} AS rk FROM r), u AS (SELECT channel, count(DISTINCT user_id) AS n_units FROM r GROUP BY 1)
SELECT m.method, u.channel, round(avg(rk), 6) AS mean_rank, n_units, count(rk) AS n_ranked FROM u CROSS JOIN (VALUES ('hourly'), ('linear'), ('locf'), ('mean')) m(method) LEFT JOIN k ON k.method = m.method AND k.channel = u.channel GROUP BY m.method, u.channel, n_units""")
def stacked_ranks(spark, d):
    rows = user_errors(spark, d).where("e < 60").withColumn("e", F.round("e", 9))
    return W.stacked_ranks(rows, METHODS, ["channel"], "user_id", "e").withColumn("mean_rank", tidy(F.col("mean_rank")))


@query("label_window", f"""WITH {EVENTS}, c AS (SELECT user_id, max(day) + 7 AS cutoff FROM ev WHERE channel = 'signup' GROUP BY 1),
dv AS (SELECT ev.user_id, date_diff('day', DATE '2024-01-01', day) AS dn, sum(value) AS v FROM ev LEFT JOIN c ON c.user_id = ev.user_id WHERE cutoff IS NULL OR day <= cutoff GROUP BY 1, 2), m AS (SELECT user_id, max(dn) AS hi FROM dv GROUP BY 1),
g AS (SELECT user_id, p AS position, hi - 13 + p AS dn FROM m, range(0, 14) r(p)) SELECT g.user_id, g.position::INTEGER AS position, g.dn, round(coalesce(v, 0), 6) AS v, (v IS NULL)::INTEGER AS missing FROM g LEFT JOIN dv ON g.user_id = dv.user_id AND g.dn = dv.dn""")
def label_window(spark, d):
    """Two weeks up to the last day observed until a week after the user's last label, padded; users without labels keep all days."""
    own = events(spark, d)
    seen = P.before_cutoff(own, P.cutoff_table(own.where("channel = 'signup'"), "user_id", "day", 7), "user_id", "day")
    daily = seen.groupBy("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("dn")).agg(F.sum("value").alias("v"))
    return C.tail_window(daily, ["user_id"], "dn", "v", 14).withColumn("v", tidy(F.col("v")))


@query("impute_windows", f"""WITH {CELLS}, x AS (SELECT DISTINCT user_id, hour_idx // 24 AS dn FROM cells), n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY dn) - 1) // 3 AS window_no FROM x),
w AS (SELECT *, min(dn) OVER (PARTITION BY user_id, window_no) AS first_day FROM n), j AS (SELECT c.user_id, c.channel, hour_idx, dn, window_no, first_day, masked, CASE WHEN NOT masked THEN v END AS known FROM cells c JOIN w ON w.user_id = c.user_id AND w.dn = c.hour_idx // 24),
f AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY user_id, window_no, channel ORDER BY hour_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, avg(known) OVER (PARTITION BY user_id, window_no, channel) AS m FROM j)
SELECT user_id, dn, first_day, count(*) AS n_filled, round(sum(coalesce(a, m, 0)), 4) AS total FROM f WHERE masked GROUP BY 1, 2, 3""")
def impute_windows(spark, d):
    own = cells(spark, d).withColumn("dn", F.floor(F.col("hour_idx") / 24).cast("long"))
    got = W.impute_windows(own, own.select("user_id", "dn"), "user_id", "dn", "channel", "hour_idx", "v", "masked", 3)
    return got.groupBy("user_id", "dn", "first_day").agg(F.count(F.lit(1)).alias("n_filled"), F.round(F.sum("pred"), 4).alias("total"))


@query("history_starts", f"""WITH {EVENTS}, l AS (SELECT user_id, max(hour_idx) + 1 AS t FROM ev GROUP BY 1), s AS (SELECT user_id, unnest(generate_series(1, (t - 24) // 24)) AS day FROM l WHERE t >= 48)
SELECT user_id, day, day * 24 AS start, least(day * 24, 168) AS n_history, (day * 24 < 168) AS is_short FROM s""")
def history_starts(spark, d):
    lengths = events(spark, d).groupBy("user_id").agg((F.max("hour_idx") + 1).alias("hours"))
    starts = C.forecast_days(lengths, "user_id", "hours", 24)
    full = W.history_starts(starts, "day", 168, include_short=False).select("user_id", "day", F.lit(False).alias("is_short"))
    return W.history_starts(starts, "day", 168, include_short=True).join(full, ["user_id", "day"], "left").select("user_id", "day", "start", "n_history", F.coalesce("is_short", F.lit(True)).alias("is_short"))
