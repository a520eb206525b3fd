"""Queries over days and labels: activity, sleep, heart rate, validity, personal fill values, adapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmere.functions.columns import tidy
from quillmere.operators import calendar as C
from quillmere.operators import daily as D
from quillmere.operators import labels as LB
from quillmere.operators import lookup as J
from quillmere.plans.base import CATEGORY_SQL, CATEGORY, EVENTS, USER_ERRORS, events, lookup, query, table, user_errors
from quillmere.plans.days import DAYS, days, text
from quillmere.plans.tracks import _FORECAST, _forecast

#: A row per user, day and hour of the day, a column per channel: steps, heart rate, workout, sleep and time in bed.
_HOURS = EVENTS + """,
hr AS (SELECT user_id, day, (hour_idx % 24)::INTEGER AS h, floor(sum(value) FILTER (channel = 'click') / 60)::DOUBLE AS steps, sum(value) FILTER (channel = 'view') AS heart,
  sum(value) FILTER (channel = 'purchase') AS workout, sum(value) FILTER (channel = 'error') AS asleep, sum(value) FILTER (channel = 'signup') AS in_bed FROM ev GROUP BY 1, 2, 3)"""


def hours(spark, d):
    own = lambda c: F.sum(F.when(F.col("channel") == c, F.col("value")))
    return events(spark, d).groupBy("user_id", "day", F.pmod("hour_idx", F.lit(24)).cast("int").alias("h")).agg(
        F.floor(own("click") / 60).cast("double").alias("steps"), own("view").alias("heart"), own("purchase").alias("workout"), own("error").alias("asleep"), own("signup").alias("in_bed")
    )


KEYS = ["user_id", "day"]


@query("active_minutes", f"""WITH {_HOURS} SELECT user_id, day::VARCHAR AS day, count(*) FILTER (steps > 0) AS steps_active, count(*) FILTER (heart > 0) AS heart_active FROM hr GROUP BY 1, 2""")
def active_minutes(spark, d):
    return D.active_minutes(hours(spark, d), KEYS, ["steps", "heart"]).withColumn("day", text("day"))


@query("wake_sedentary", f"""WITH {_HOURS} SELECT user_id, day::VARCHAR AS day, greatest(count(*) FILTER (h BETWEEN 6 AND 21 AND steps = 0) - count(*) FILTER (h BETWEEN 6 AND 21 AND asleep IS NOT NULL), 0) AS sedentary FROM hr GROUP BY 1, 2""")
def wake_sedentary(spark, d):
    rows = hours(spark, d).withColumn("off", F.col("asleep").isNotNull())
    return D.wake_sedentary(rows, KEYS, "h", "steps", "off", (6, 22)).withColumn("day", text("day"))


@query("heart_over_steps", f"""WITH {_HOURS}, g AS (SELECT user_id, day, median(heart) FILTER (h BETWEEN 6 AND 21 AND heart > 0) AS m, sum(steps) FILTER (h BETWEEN 6 AND 21) AS s, count(*) FILTER (h BETWEEN 6 AND 21 AND steps > 0) AS a FROM hr GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, round(m / (CASE WHEN a > 0 THEN s / a END + 1), 6) AS hros FROM g""")
def heart_over_steps(spark, d):
    return D.heart_over_steps(hours(spark, d), KEYS, "h", "heart", "steps", (6, 22)).select("user_id", text("day"), tidy(F.col("hros")).alias("hros"))


def _median_at(edge: str, step: int) -> str:
    start = f"greatest({edge} + {step} - 2, 0)"
    return f"median(heart) FILTER (h >= {start} AND h <= {start} + 4 AND heart > 0)"


@query("workout_heart", f"""WITH {_HOURS}, w AS (SELECT user_id, day, min(h) AS lo, max(h) AS hi FROM hr WHERE workout > 0 GROUP BY 1, 2),
m AS (SELECT user_id, day, {_median_at("hi", 0)} AS e0, {_median_at("hi", 1)} AS e1, {_median_at("hi", 3)} AS e3, {_median_at("hi", 6)} AS e6, {_median_at("lo", 0)} AS s0, {_median_at("lo", 3)} AS s3, {_median_at("lo", 6)} AS s6 FROM hr JOIN w USING (user_id, day) GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, round(e0, 6) AS at_end, round(e0 - e1, 6) AS recovery_1, round(e0 - e3, 6) AS recovery_3, round(e0 - e6, 6) AS recovery_6, round(CASE WHEN e0 > 0 THEN (e0 - e3) / e0 END, 6) AS recovery_ratio,
round(s0, 6) AS at_start, round(s3 - s0, 6) AS activation_3, round(s6 - s0, 6) AS activation_6, round(CASE WHEN s0 > 0 THEN (s3 - s0) / s0 END, 6) AS activation_ratio FROM m""")
def workout_heart(spark, d):
    got = D.workout_heart(hours(spark, d), KEYS, "h", "heart", "workout", (1, 3, 6), 2)
    return got.select("user_id", text("day"), *[tidy(F.col(c)).alias(c) for c in got.columns if c not in KEYS])


_SLEEP = "SELECT user_id, day, (count(asleep) > 0)::INTEGER AS has_data, sum(asleep) AS asleep, sum(in_bed) AS in_bed, CASE WHEN count(asleep) > 0 AND sum(in_bed) > 0 THEN least(sum(asleep) / sum(in_bed), 1.0) END AS efficiency FROM hr GROUP BY 1, 2"


@query("sleep_efficiency", f"""WITH {_HOURS}, s AS ({_SLEEP}) SELECT user_id, day::VARCHAR AS day, has_data, round(asleep, 4) AS asleep, round(in_bed, 4) AS in_bed, round(efficiency, 6) AS efficiency FROM s""")
def sleep_efficiency(spark, d):
    got = D.sleep_efficiency(hours(spark, d), KEYS, "asleep", "in_bed")
    return got.select("user_id", text("day"), "has_data", tidy(F.col("asleep"), 4).alias("asleep"), tidy(F.col("in_bed"), 4).alias("in_bed"), tidy(F.col("efficiency")).alias("efficiency"))


def _nearest(p: float, c: str) -> str:
    return f"{c}[1 + floor({p} * (len({c}) - 1) + 0.5)::INT]"


@query("activity_users", f"""WITH {_HOURS}, a AS (SELECT user_id, day, count(*) FILTER (steps > 0) AS act, sum(heart) AS beat, max(CASE WHEN workout > 0 THEN 1 ELSE 0 END) AS wo FROM hr GROUP BY 1, 2),
u AS (SELECT user_id, list(act ORDER BY act) AS la, list(beat ORDER BY beat) FILTER (beat IS NOT NULL) AS lb, median(act) AS ma, median(beat) AS mb, avg(wo) AS density FROM a GROUP BY 1)
SELECT user_id, round(ma, 4) AS active_p50, round(({_nearest(0.75, "la")} - {_nearest(0.25, "la")})::DOUBLE, 4) AS active_iqr, round(mb, 4) AS beat_p50, round({_nearest(0.75, "lb")} - {_nearest(0.25, "lb")}, 4) AS beat_iqr, round(density, 6) AS workout_density FROM u""")
def activity_users(spark, d):
    per = hours(spark, d).groupBy(*KEYS).agg(F.count_if(F.col("steps") > 0).cast("double").alias("active"), F.sum("heart").alias("beat"), F.max(F.when(F.col("workout") > 0, 1).otherwise(0)).alias("wo"))
    spread = D.user_spread(per, "user_id", ["active", "beat"]).join(per.groupBy("user_id").agg(tidy(F.avg("wo")).alias("workout_density")), "user_id")
    return spread.select("user_id", *[tidy(F.col(c), 4).alias(c) for c in ("active_p50", "active_iqr", "beat_p50", "beat_iqr")], "workout_density")


@query("heart_profile", f"""WITH {_HOURS}, p AS (SELECT user_id, h, avg(heart) AS b, avg(steps) AS s FROM hr GROUP BY 1, 2), x AS (SELECT user_id, h, b / (coalesce(s, 0) + 1) AS r FROM p),
g AS (SELECT user_id, avg(r) AS mean, stddev_pop(r) AS std, avg(r) FILTER (h BETWEEN 6 AND 21) AS dm, avg(r) FILTER (h < 6 OR h >= 23) AS nm FROM x GROUP BY 1)
SELECT user_id, round(mean, 6) AS mean, round(std, 6) AS std, round(dm, 6) AS day_mean, round(nm, 6) AS night_mean, round(CASE WHEN nm > 0 THEN dm / nm END, 6) AS day_night_ratio FROM g""")
def heart_profile(spark, d):
    mean_day = hours(spark, d).groupBy("user_id", "h").agg(F.avg("heart").alias("b"), F.avg("steps").alias("s"))
    got = D.profile_over_steps(mean_day, "user_id", "h", "b", "s", (6, 22), 23)
    return got.select("user_id", *[tidy(F.col(c)).alias(c) for c in ("mean", "std", "day_mean", "night_mean", "day_night_ratio")])


@query("day_retain_mask", f"""WITH {DAYS} SELECT user_id, string_agg(day::VARCHAR, ',' ORDER BY day) AS days, count(*) AS n FROM dy WHERE nonwear <= 720 AND total > 100 GROUP BY 1""")
def day_retain_mask(spark, d):
    got = D.retained_days(days(spark, d), "user_id", "day", (F.col("nonwear") <= 720) & (F.col("total") > 100))
    return got.select("user_id", F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days"), F.size("days").cast("long").alias("n"))


@query("day_tensors", f"""WITH {_HOURS}, x AS (SELECT DISTINCT user_id, day FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i FROM x),
p AS (SELECT r.user_id, (i // 3)::BIGINT AS chunk, day, (i % 3) * 24 + h AS pos, heart FROM r JOIN hr USING (user_id, day))
SELECT user_id, chunk, count(DISTINCT day) * 24 AS n_cells, count(heart) AS n_known, round(coalesce(sum(heart * (pos + 1)), 0), 3) AS weighted FROM p GROUP BY 1, 2""")
def day_tensors(spark, d):
    """Chunks of three observed days end to end, described by their cells and a sum weighted by place."""
    own = hours(spark, d)
    got = D.day_tensors(C.observed_chunks(own, "user_id", "day", 3), own, "user_id", "day", "h", "heart")
    weighted = F.aggregate(F.transform("tensor", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return got.select("user_id", "chunk", F.size("tensor").cast("long").alias("n_cells"), F.size(F.filter("tensor", lambda v: v.isNotNull())).cast("long").alias("n_known"), F.round(weighted, 3).alias("weighted"))


# -- labels


_VALID = EVENTS + """, s AS (SELECT user_id, channel AS label, ts, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, channel) AS n FROM ev WINDOW w AS (PARTITION BY user_id, channel ORDER BY ts, event_id)),
m AS (SELECT user_id, label, list(value >= 50 ORDER BY ts, event_id) AS mask FROM s WHERE label = 'signup' OR (label = 'error' AND user_id % 2 = 0) GROUP BY 1, 2),
v AS (SELECT s.*, CASE WHEN len(mask) = n THEN mask[i] END AS valid FROM s LEFT JOIN m USING (user_id, label))"""


def _valid(spark, d):
    s = events(spark, d).select("user_id", F.col("channel").alias("label"), "ts", "event_id", "value")
    marked = s.where("label = 'signup' OR (label = 'error' AND user_id % 2 = 0)")
    sorted_mask = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"] >= 50)
    masks = marked.groupBy("user_id", "label").agg(sorted_mask.alias("mask"))
    return LB.attach_validity(s, masks, ["user_id", "label"], ["ts", "event_id"])


@query("label_validity", f"WITH {_VALID} SELECT label, count(*) AS n, count(valid) AS n_masked, count(*) FILTER (valid IS NULL OR valid) AS n_valid FROM v GROUP BY 1")
def label_validity(spark, d):
    v = _valid(spark, d)
    kept = LB.only_valid(v).groupBy("label").agg(F.count(F.lit(1)).alias("n_valid"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("valid").alias("n_masked")).join(kept, "label").select("label", "n", "n_masked", "n_valid")


@query("context_lookup", f"""WITH {_VALID}, q AS (SELECT event_id, user_id, ts FROM ev WHERE channel = 'purchase'), c AS (SELECT user_id, label, ts AS sts, min(value) AS val FROM v WHERE (valid IS NULL OR valid) AND label IN ('signup', 'error') GROUP BY 1, 2, 3)
SELECT q.event_id, c.label, round(arg_min(c.val, struct_pack(a := abs(epoch_us(c.sts) - epoch_us(q.ts)), b := c.sts)), 6) AS match_value FROM q JOIN c ON c.user_id = q.user_id GROUP BY 1, 2""")
def context_lookup(spark, d):
    """The nearest valid value of every label but the target's, for each of its events."""
    q = events(spark, d).where("channel = 'purchase'").select("event_id", "user_id", "ts")
    context = LB.only_valid(_valid(spark, d)).where("label IN ('signup', 'error')").select("user_id", "label", F.col("ts").alias("sts"), "value")
    key = F.concat_ws(":", "user_id", "label")
    each = q.withColumn("label", F.explode(F.array(F.lit("signup"), F.lit("error")))).withColumn("k", key)
    got = J.asof_nearest(each, context.withColumn("k", key).select("k", "sts", "value"), "k", "ts", "sts", "value")
    return got.where("match_ts IS NOT NULL").select("event_id", "label", tidy(F.col("match_value")).alias("match_value"))


@query("manifest_drop", f"WITH {EVENTS}, m AS (SELECT user_id, day FROM ev GROUP BY 1, 2 HAVING sum(value) > 200) SELECT channel, count(*) AS n, count(m.user_id) AS n_kept FROM ev LEFT JOIN m ON m.user_id = ev.user_id AND m.day = ev.day GROUP BY 1")
def manifest_drop(spark, d):
    pairs = events(spark, d).select("user_id", "day", "channel")
    manifest = events(spark, d).groupBy(*KEYS).agg(F.sum("value").alias("s")).where("s > 200").select(*KEYS)
    kept = LB.with_manifest(pairs, manifest, KEYS).groupBy("channel").agg(F.count(F.lit(1)).alias("n_kept"))
    return pairs.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).join(kept, "channel", "left").select("channel", "n", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query("sex_normalise", """WITH t AS (SELECT ['male', 'F', '1', '0', 'TRUE', 'woman', ' m ', 'x', '2'][1 + c_custkey % 9] AS w FROM customer) SELECT w AS token, CASE WHEN lower(trim(w)) IN ('male', 'm', 'man', 'true', '1') THEN 'male' WHEN lower(trim(w)) IN ('female', 'f', 'woman', 'false', '0') THEN 'female' ELSE 'unknown' END AS sex,
CASE WHEN lower(trim(w)) IN ('male', 'm', 'man', 'true') THEN 'male' WHEN lower(trim(w)) IN ('female', 'f', 'woman', 'false') THEN 'female' ELSE 'unknown' END AS sex_words, count(*) AS n FROM t GROUP BY ALL""")
def sex_normalise(spark, d):
    tokens = F.array(*[F.lit(t) for t in ("male", "F", "1", "0", "TRUE", "woman", " m ", "x", "2")])
    t = table(spark, d, "customer").select(F.element_at(tokens, (F.col("c_custkey") % 9 + 1).cast("int")).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", LB.normalise_sex(F.col("token")).alias("sex"), LB.normalise_sex(F.col("token"), numbers=False).alias("sex_words"), "n")


# -- personal fill values


@query("personal_mode", f"""WITH {EVENTS}, r AS (SELECT user_id, channel, day, floor(avg(value) / 25)::BIGINT AS v FROM ev GROUP BY 1, 2, 3), c AS (SELECT user_id, channel, v, count(*) AS c FROM r GROUP BY 1, 2, 3),
o AS (SELECT r.user_id, r.channel, r.day, arg_max(c.v, struct_pack(a := c.c - (c.v = r.v)::INT, b := -c.v)) AS mode FROM r JOIN c ON c.user_id = r.user_id AND c.channel = r.channel AND c.c - (c.v = r.v)::INT > 0 GROUP BY 1, 2, 3)
SELECT r.user_id, r.channel, r.day::VARCHAR AS day, o.mode FROM r LEFT JOIN o ON o.user_id = r.user_id AND o.channel = r.channel AND o.day = r.day""")
def personal_mode(spark, d):
    """A user's most frequent daily level, the day itself left out."""
    r = events(spark, d).groupBy("user_id", "channel", "day").agg(F.floor(F.avg("value") / 25).cast("long").alias("v"))
    return LB.leave_one_out_mode(r, ["user_id", "channel"], "v").select("user_id", "channel", text("day"), "mode")


@query("personal_hour_mean", f"""WITH {EVENTS}, r AS (SELECT user_id, day, hour_idx % 24 AS h, sum(value) AS v FROM ev GROUP BY 1, 2, 3), g AS (SELECT h, avg(v) AS g FROM r GROUP BY 1),
w AS (SELECT *, sum(v) OVER p AS s, count(*) OVER p AS n FROM r WINDOW p AS (PARTITION BY user_id, h)) SELECT user_id, day::VARCHAR AS day, h, round(CASE WHEN n > 1 THEN (s - v) / (n - 1) ELSE g END, 6) AS fill FROM w JOIN g USING (h)""")
def personal_hour_mean(spark, d):
    """A user's mean at an hour of the day without the sample itself; alone, the mean of all users."""
    from quillmere.operators.impute import leave_one_out_mean

    r = events(spark, d).groupBy("user_id", "day", F.pmod("hour_idx", F.lit(24)).alias("h")).agg(F.sum("value").alias("v"))
    all_users = r.groupBy("h").agg(F.avg("v").alias("g"))
    return r.join(all_users, "h").withColumn("fill", leave_one_out_mean(r, ["user_id", "h"], "v", "g")).select("user_id", text("day"), "h", tidy(F.col("fill")).alias("fill"))


@query("hour_mode", f"""WITH {EVENTS}, r AS (SELECT channel, hour_idx % 24 AS h, floor(value / 25)::BIGINT AS v, count(*) AS c FROM ev GROUP BY 1, 2, 3) SELECT channel, h, arg_max(v, struct_pack(a := c, b := -v)) AS mode FROM r GROUP BY 1, 2""")
def hour_mode(spark, d):
    """The most frequent level at each hour of the day, the smallest on a tie."""
    c = events(spark, d).groupBy("channel", F.pmod("hour_idx", F.lit(24)).alias("h"), F.floor(F.col("value") / 25).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("channel", "h").agg(F.max_by("v", F.struct("c", (-F.col("v")).alias("m"))).alias("mode"))


# -- metrics and adapters


@query("collapsed_binary", f"WITH {USER_ERRORS}, a AS (SELECT method, user_id, channel, CASE WHEN e < 90 THEN 1 - e / 100 END AS auc FROM ue) SELECT method, user_id, {CATEGORY_SQL} AS category, round(avg(1 - auc), 9) AS e FROM a GROUP BY ALL HAVING count(auc) > 0")
def collapsed_binary(spark, d):
    """One error per user and category: the mean of one less the AUC over the category's channels that have one."""
    a = user_errors(spark, d).withColumn("auc", F.when(F.col("e") < 90, 1 - F.col("e") / 100))
    return a.where("auc IS NOT NULL").groupBy("method", "user_id", lookup(CATEGORY, "channel").alias("category")).agg(tidy(F.avg(1 - F.col("auc")), 9).alias("e"))


@query("finite_cell_sums", """WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), y AS (SELECT i, CASE WHEN v > 0 THEN v END AS v FROM x) SELECT i::INTEGER AS channel, round(sum(v), 4) AS total, count(v) AS n FROM y GROUP BY 1""")
def finite_cell_sums(spark, d):
    """Sum and count of the finite cells of nested metric arrays, per channel; what is not positive counts as NaN here."""
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("channel", "v"))
    own = F.nanvl(F.when(F.col("v") > 0, F.col("v").cast("double")).otherwise(float("nan")), F.lit(None).cast("double"))
    return x.withColumn("w", own).groupBy("channel").agg(F.round(F.sum("w"), 4).alias("total"), F.count("w").alias("n"))


@query("zero_merged_channels", f"WITH {EVENTS} SELECT channel, CASE WHEN channel IN ('view') THEN 0 ELSE round(avg(value), 6) END AS metric FROM ev GROUP BY 1")
def zero_merged_channels(spark, d):
    m = events(spark, d).groupBy("channel").agg(tidy(F.avg("value")).alias("m"))
    return m.select("channel", F.when(F.col("channel").isin("view"), 0.0).otherwise(F.col("m")).alias("metric"))


@query("quantile_fallback", f"WITH {_FORECAST} SELECT user_id, ahead::INTEGER AS ahead, CASE WHEN user_id % 2 = 0 THEN 3 ELSE 1 END AS n_levels, round(CASE WHEN user_id % 2 = 0 THEN pred * 0.9 ELSE pred END, 6) AS low FROM f")
def quantile_fallback(spark, d):
    """Quantiles where a forecast has them, else its point as the only one."""
    p = F.col("pred")
    q = F.when(F.col("user_id") % 2 == 0, F.array(p * 0.9, p, p * 1.1))
    got = _forecast(spark, d)[1].withColumn("q", F.coalesce(q, F.array(p)))
    return got.select("user_id", "ahead", F.size("q").alias("n_levels"), tidy(F.col("q")[0]).alias("low"))


@query("seasonal_fallback", f"WITH {_FORECAST} SELECT user_id, ahead::INTEGER AS ahead, round(CASE WHEN (user_id + ahead) % 3 = 0 THEN pred ELSE 10 * ahead END, 6) AS pred, (user_id + ahead) % 3 = 0 AS is_fallback FROM f")
def seasonal_fallback(spark, d):
    """A model's forecast with seasonal naive where it gives none."""
    naive = _forecast(spark, d)[1].select("user_id", "ahead", "pred")
    model = naive.select("user_id", "ahead", F.when(F.pmod(F.col("user_id") + F.col("ahead"), F.lit(3)) != 0, F.col("ahead") * 10.0).otherwise(float("nan")).alias("pred"))
    return LB.seasonal_fallback(model, naive, ["user_id", "ahead"]).withColumn("pred", tidy(F.col("pred")))


@query("prediction_table", "SELECT doc_id, (n_chars / 4000.0::DOUBLE >= 0.5)::INT::DOUBLE AS y_binary, round_even(n_chars / 1000.0::DOUBLE, 0) AS y_ordinal, round(n_chars / 4000.0::DOUBLE, 6) AS y_proba FROM documents")
def prediction_table(spark, d):
    docs = table(spark, d, "documents")
    a = LB.prediction_table(docs.select("doc_id", (F.col("n_chars") / 4000.0).alias("prediction")), "binary").select("doc_id", F.col("y_pred").alias("y_binary"), tidy(F.col("y_proba")).alias("y_proba"))
    b = LB.prediction_table(docs.select("doc_id", (F.col("n_chars") / 1000.0).alias("prediction")), "ordinal").select("doc_id", F.col("y_pred").alias("y_ordinal"))
    return a.join(b, "doc_id")


@query("baseline_rows", f"WITH {USER_ERRORS} SELECT channel, user_id, round(e, 6) AS e FROM ue WHERE method = 'locf' AND channel NOT IN ('error', 'signup')")
def baseline_rows(spark, d):
    """The baseline's errors without the binary channels."""
    return user_errors(spark, d).where("method = 'locf' AND channel NOT IN ('error', 'signup')").select("channel", "user_id", tidy(F.col("e")).alias("e"))


@query("error_adapter", f"WITH {USER_ERRORS}, x AS (SELECT method, channel, user_id, e FROM ue UNION ALL SELECT method, {CATEGORY_SQL}, user_id, e FROM ue UNION ALL SELECT method, 'overall', user_id, e FROM ue) SELECT method, channel AS collection, round(avg(e), 6) AS e, count(DISTINCT user_id) AS n_users FROM x GROUP BY 1, 2")
def error_adapter(spark, d):
    """Errors under their channel, category and all together: one explode instead of three scans."""
    names = F.array(F.col("channel"), lookup(CATEGORY, "channel"), F.lit("overall"))
    x = user_errors(spark, d).withColumn("collection", F.explode(names))
    return x.groupBy("method", "collection").agg(tidy(F.avg("e")).alias("e"), F.countDistinct("user_id").alias("n_users"))


@query("leaderboard_sort", f"WITH {USER_ERRORS}, m AS (SELECT method, round(avg(e), 6) AS e FROM ue GROUP BY 1) SELECT method, e, row_number() OVER (ORDER BY e, method) AS place FROM m")
def leaderboard_sort(spark, d):
    m = user_errors(spark, d).groupBy("method").agg(tidy(F.avg("e")).alias("e"))
    return m.withColumn("place", F.row_number().over(Window.orderBy("e", "method")).cast("long")).orderBy("place")  # a row per method


@query("rows_by_key", f"WITH {EVENTS}, k AS (SELECT DISTINCT user_id, day FROM ev WHERE channel = 'signup') SELECT ev.user_id, ev.day::VARCHAR AS day, ev.event_id FROM ev JOIN k ON k.user_id = ev.user_id AND k.day = ev.day")
def rows_by_key(spark, d):
    """The rows of asked (user, day) keys, sorted inside the parts they are in."""
    e = events(spark, d)
    got = e.join(e.where("channel = 'signup'").select(*KEYS).distinct(), KEYS).sortWithinPartitions("user_id", "day", "event_id")
    return got.select("user_id", text("day"), "event_id")


@query("covariates", "SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def covariates(spark, d):
    """All of a table but the target, what tells it by another name, and prefixed helpers."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"), "c_nationkey", F.col("c_nationkey").alias("nation"), F.lit(1).alias("n_rows"), F.lit(2).alias("total_x"))
    return LB.without_prefixes(LB.covariates(c, "c_nationkey", {"c_nationkey": ["nation"]}), ("n_", "total_"))


@query("stats_left_join", f"WITH {DAYS}, s AS (SELECT user_id, avg(total) AS mean FROM dy GROUP BY 1), l AS (SELECT user_id, day, total, lag(total) OVER (PARTITION BY user_id ORDER BY day) AS p FROM dy), c AS (SELECT user_id, corr(total, p) AS c FROM l WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) >= 10) SELECT s.user_id, round(mean, 6) AS mean, round(c, 6) AS lag1 FROM s LEFT JOIN c USING (user_id)")
def stats_left_join(spark, d):
    """Moments of every user beside dynamics that only long series have."""
    dy = days(spark, d)
    lagged = dy.withColumn("p", F.lag("total").over(Window.partitionBy("user_id").orderBy("day"))).where("p IS NOT NULL")
    dynamics = lagged.groupBy("user_id").agg(F.corr("total", "p").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return dy.groupBy("user_id").agg(tidy(F.avg("total")).alias("mean")).join(dynamics, "user_id", "left").select("user_id", "mean", tidy(F.nanvl("c", F.lit(None).cast("double"))).alias("lag1"))


_INDEX = EVENTS + """, t AS (SELECT user_id, max(hour_idx) + 1 AS t FROM ev GROUP BY 1), c AS (SELECT user_id, unnest(generate_series(1, (t - 48) // 24)) AS day FROM t WHERE t >= 72), r AS (SELECT DISTINCT user_id, hour_idx // 24 AS day FROM ev),
a AS (SELECT * FROM c WHERE (SELECT count(*) FROM r WHERE r.user_id = c.user_id AND r.day BETWEEN c.day AND c.day + 1) = 2),
b AS (SELECT * FROM a WHERE (SELECT count(*) FROM r WHERE r.user_id = a.user_id AND r.day BETWEEN a.day - 7 AND a.day - 1) >= 3),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, day) AS i FROM b) WHERE i <= 5)"""


@query("forecast_index", f"""WITH {_INDEX.format(order="day")} SELECT 'all' AS name, count(*) AS n FROM c UNION ALL SELECT 'all_M', count(*) FROM a UNION ALL SELECT 'all_M_H_7_3', count(*) FROM b UNION ALL SELECT 'all_M_H_7_3_S_5', count(*) FROM e""")
def forecast_index(spark, d):
    """Candidate days through the filters in their order; each result's name tells them."""
    e = events(spark, d)
    kept = e.select("user_id", F.floor(F.col("hour_idx") / 24).alias("day")).distinct()
    candidates = C.forecast_days(e.groupBy("user_id").agg((F.max("hour_idx") + 1).alias("t")), "user_id", "t", 48)
    steps = {"M": lambda x: C.with_retained_future(x, kept, "user_id", 2), "H_7_3": lambda x: C.with_retained_past(x, kept, "user_id", 7, 3), "S_5": lambda x: C.capped(x, "user_id", 5, "day")}
    named = C.index_pipeline(candidates, steps, "all")
    out = [f.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, f in named.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])
