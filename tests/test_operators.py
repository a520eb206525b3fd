"""Operators on small tables with known answers and against plain Python."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere import api
from quillmere.functions import columns as X
from quillmere.operators import calendar as C
from quillmere.operators import features as FT
from quillmere.operators import filters as P
from quillmere.operators import impute as I
from quillmere.operators import leaderboard as L
from quillmere.operators import lookup as J
from quillmere.operators import metrics as M
from quillmere.operators import models as ML


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


def _array(*xs):
    return F.array(*[F.lit(x).cast("double") for x in xs])


def test_zero_rules(spark):
    zeros = _array(0, 0, 0)
    assert _one(spark, X.zero_to_missing(_array(0, 5, 0), "each")) == [None, 5.0, None]
    assert _one(spark, X.zero_to_missing(zeros, "whole")) == [None] * 3 and _one(spark, X.zero_to_missing(_array(0, 1), "whole")) == [0.0, 1.0]
    assert _one(spark, X.zero_to_missing(zeros, "sleep")) == [None] * 3 and _one(spark, X.zero_to_missing(zeros, "sleep", strict=True)) == [0.0] * 3
    assert _one(spark, X.zero_to_missing(_array(0, 200), "sleep")) == [0.0, 200.0]
    with pytest.raises(ValueError):
        X.zero_to_missing(zeros, "other")


def test_columns(spark):
    assert _one(spark, X.nearest_quantile(_array(4, 1, 3, 2, 5), 0.25)) == 2.0
    assert _one(spark, X.nearest_quantile(F.array().cast("array<double>"), 0.5)) is None
    assert _one(spark, X.array_mean(_array(1, None, 3))) == 2.0
    assert _one(spark, X.circular_sums(_array(*range(24)), 5))[22] == 22 + 23 + 0 + 1 + 2
    assert _one(spark, X.finite(F.lit(float("inf")))) is None and _one(spark, X.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert _one(spark, X.sentinel_to_null(F.lit(-1))) is None and _one(spark, X.sentinel_to_null(F.lit(3))) == 3
    assert [_one(spark, X.age_band(F.lit(a))) for a in (17, 18, 45, 60)] == ["unknown", "18-29", "40-49", "60+"]
    assert _one(spark, X.age_band(F.lit(17), young="18-29")) == "18-29"
    assert _one(spark, X.enforce_bool(F.lit(" Yes "))) is True and _one(spark, X.enforce_int(F.lit("2.5"))) is None
    assert _one(spark, X.skill_ratio(F.lit(1.0), F.lit(0.001))) == 100.0 and _one(spark, X.skill_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert _one(spark, X.metric_to_error(F.lit(0.999), F.lit(True))) == 0.005 and _one(spark, X.metric_to_error(F.lit(1.5), F.lit(True))) is None


def test_filters(spark):
    rows = spark.createDataFrame([(1, 720.0, [0.5, 2.0]), (2, 721.0, [2.0, 2.0]), (3, 0.0, [float("nan"), 2.0]), (4, 0.0, None)], "id int, nonwear double, v array<double>")
    assert {r.id for r in P.wear_filter(rows, "nonwear").collect()} == {1, 3, 4}
    assert {r.id for r in P.variance_filter(rows, "v", {0: 1.0, 7: 1.0}).collect()} == {2, 3, 4}
    kept, report = P.filter_chain(rows, [("wear", F.col("nonwear") <= 720), ("id", F.col("id") > 1)])
    assert kept.count() == 2 and [tuple(r) for r in report.orderBy("step_no").collect()] == [(1, "wear", 4, 3), (2, "id", 3, 2)]
    cut = P.before_cutoff(spark.createDataFrame([(1, date(2024, 1, 5)), (1, date(2024, 1, 9)), (2, date(2024, 1, 9))], "u int, d date"), P.cutoff_table(spark.createDataFrame([(1, date(2024, 1, 3))], "u int, d date"), "u", "d", 2), "u", "d")
    assert cut.count() == 2


_T = datetime(2024, 1, 1)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), min_size=1, max_size=25), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60)), min_size=1, max_size=25))
def test_asof_against_plain_python(spark_now, series, queries):
    at = lambda m: _T + timedelta(minutes=m)
    q = spark_now.createDataFrame([(i, k, at(m)) for i, (k, m) in enumerate(queries)], "i int, k int, ts timestamp_ntz")
    s = spark_now.createDataFrame([(k, at(m), float(m)) for k, m in series], "k int, sts timestamp_ntz, v double")
    got = {r.i: r.match_value for r in J.asof_nearest(q, s, "k", "ts", "sts", "v").collect()}
    for i, (k, m) in enumerate(queries):
        own = sorted((abs(t - m), t) for kk, t in series if kk == k)
        assert got[i] == (float(own[0][1]) if own else None)


@pytest.fixture(scope="module")
def spark_now(spark):
    return spark


def test_range_and_intervals(spark):
    q = spark.createDataFrame([(1, 1, _T + timedelta(days=10))], "i int, k int, ts timestamp_ntz")
    s = spark.createDataFrame([(1, _T + timedelta(days=d)) for d in (6, 7, 8, 13, 14)], "k int, sts timestamp_ntz")
    assert J.range_pairs(q, s, "k", "ts", "sts", 3).count() == 3
    spans = J.intervals_from_events(spark.createDataFrame([(1, _T + timedelta(days=d), f"n{d}") for d in (2, 9, 12)], "k int, t timestamp_ntz, n string"), "k", "t", "n")
    assert J.interval_lookup(q, spans, "k", "ts").first().interval_name == "n9"
    closed = spark.createDataFrame([(1, _T, _T + timedelta(days=1), "a"), (1, _T + timedelta(days=2), _T + timedelta(days=3), "b")], "k int, start timestamp_ntz, end timestamp_ntz, name string")
    at = spark.createDataFrame([(i, 1, _T + timedelta(days=x)) for i, x in enumerate((0, 1, 1.5, 2, 3, 4))], "i int, k int, ts timestamp_ntz")
    assert [r.interval_name for r in J.interval_lookup(at, closed, "k", "ts").orderBy("i").collect()] == ["a", "a", None, "b", "b", None]  # both ends belong to it
    touching = closed.withColumn("end", F.expr("end + INTERVAL 1 DAY"))
    assert J.interval_overlaps(touching, "k").count() == 1 and J.interval_overlaps(closed, "k").count() == 0
    merged = J.merge_by_precedence(spark.createDataFrame([(1, 10)], "k int, v int"), spark.createDataFrame([(1, 20), (2, 30)], "k int, v int"), ["k"], "v")
    assert {tuple(r) for r in merged.collect()} == {(1, 10), (2, 30)}


def test_calendar_against_plain_python(spark):
    rng = random.Random(1)
    days = {u: sorted(rng.sample(range(40), rng.randrange(1, 25))) for u in range(6)}
    frame = spark.createDataFrame([(u, date(2024, 1, 1) + timedelta(days=d)) for u, ds in days.items() for d in ds], "u int, d date")
    want = set()
    for u, ds in days.items():
        for s in range(ds[0], ds[-1] - 7 + 2, 3):
            n = sum(s <= d < s + 7 for d in ds)
            if n >= 2:
                want.add((u, date(2024, 1, 1) + timedelta(days=s), n))
    assert {(r.u, r.window_start, r.n_days) for r in C.window_index(frame, "u", "d", 7, 3, 2).collect()} == want
    chunks = C.observed_chunks(frame, "u", "d", 4).collect()
    for u, ds in days.items():
        own = sorted((r.chunk, list(r.day_offsets), r.n_padding) for r in chunks if r.u == u)
        assert own == [(i, [d - ds[4 * i] for d in ds[4 * i : 4 * i + 4]], 4 - len(ds[4 * i : 4 * i + 4])) for i in range(-(-len(ds) // 4))]
    candidates = C.forecast_days(spark.createDataFrame([(1, 100), (2, 30)], "u int, t long"), "u", "t", 24)
    assert sorted((r.u, r.day) for r in candidates.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_imputers(spark):
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate([None, 2.0, None, None, 8.0, None])], "k int, t int, v double")
    got = rows.select("t", I.locf(["k"], "t", "v").alias("a"), I.linear(["k"], "t", "v").alias("b")).orderBy("t").collect()
    assert [r.a for r in got] == [2, 2, 2, 2, 8, 8] and [r.b for r in got] == [2, 2, 4, 6, 8, 8]
    alone = spark.createDataFrame([(1, 2.0, 9.0), (2, 2.0, 9.0), (2, 4.0, 9.0), (2, None, 9.0)], "k int, v double, m double")
    assert sorted(r[0] for r in alone.select(I.leave_one_out_mean(alone, ["k"], "v", "m")).collect()) == [2.0, 3.0, 4.0, 9.0]
    runs = I.runs(spark.createDataFrame([(1, t) for t in (1, 2, 3, 7, 8, 20)], "k int, t long"), ["k"], "t", F.lit(True), 2).collect()
    assert sorted((r.run_start, r.run_end, r.run_length) for r in runs) == [(1, 3, 3), (7, 8, 2)]


def test_metrics_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(2), rng.randrange(8) / 4) for k in range(5) for _ in range(rng.randrange(1, 40))]
    frame = spark.createDataFrame(rows, "k int, y int, s double")
    auc = {r.k: r.auc for r in M.roc_auc(frame, ["k"], "y", "s").collect()}
    ap = {r.k: r.ap for r in M.average_precision(frame, ["k"], "y", "s").collect()}
    for k in range(5):
        pos, neg = [s for kk, y, s in rows if kk == k and y], [s for kk, y, s in rows if kk == k and not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert auc[k] == (pytest.approx(want) if want is not None else None)
        total, last = 0.0, 0.0
        for cut in sorted(set(pos + neg), reverse=True):
            tp, fp = sum(p >= cut for p in pos), sum(n >= cut for n in neg)
            if pos:
                total, last = total + (tp / len(pos) - last) * tp / (tp + fp), tp / len(pos)
        assert ap[k] == (pytest.approx(total) if pos else None)


def test_leaderboard(spark):
    errors = spark.createDataFrame([(m, u, e * (1 + u)) for m, e in (("base", 1.0), ("half", 0.5), ("twice", 2.0)) for u in range(4)], "method string, user_id int, e double").withColumn("task", F.lit("t"))
    skill = {r.method: r.skill for r in L.paired_skill(errors, ["task"], "base").collect()}
    assert skill == {"half": pytest.approx(0.5), "twice": pytest.approx(-1.0)}
    assert {r.method: r.mean_rank for r in L.mean_ranks(errors, ["task"]).collect()} == {"half": 1.0, "base": 2.0, "twice": 3.0}
    tied = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 2.0)], "method string, user_id int, e double").withColumn("task", F.lit("t"))
    assert {r.method: r.mean_rank for r in L.mean_ranks(tied, ["task"]).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    got = L.mapd(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v").first()
    pairs = [abs(a - b) for i, a in enumerate(values) for b in values[:i]]
    assert got.mapd == pytest.approx(sum(pairs) / len(pairs))
    groups = spark.createDataFrame([(m, "sex", g, 1.0 + d * (g == "m")) for m, d in (("base", 0.4), ("fair", 0.1)) for g in "fm"], "method string, attribute string, subgroup string, e double").withColumn("task", F.lit("t"))
    fair = {r.method: r.fairness for r in L.fairness(groups, ["task"], "attribute", "subgroup", "base").collect()}
    assert fair == {"base": pytest.approx(0.0), "fair": pytest.approx(0.75)}


def test_resampling_matches_theory(spark):
    """Standard errors within 10 % of theory, in any order of values; weights are Poisson(1) and independent."""
    for n, draws in ((150, 1500), (15_000, 400)):
        for trend in (False, True):
            rows = spark.range(n).select(F.lit("m").alias("method"), "id", (F.col("id") / n if trend else F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("e"))
            s = L.draw_summary(L.bootstrap(rows, ["method"], "id", "e", draws), ["method"]).first()
            sd = rows.agg(F.stddev_pop("e")).first()[0]
            assert abs(s.se / (sd / math.sqrt(n)) - 1) < 0.1, (n, trend)
    w = spark.range(40_000).select(L.draw_weight(F.col("id"), F.lit(3)).alias("a"), L.draw_weight(F.col("id") + 1, F.lit(3)).alias("b"), L.draw_weight(F.col("id"), F.lit(4)).alias("c"))
    got = w.agg(F.avg("a").alias("m"), F.var_pop("a").alias("v"), F.max("a").alias("top"), F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac")).first()
    assert abs(got.m - 1) < 0.03 and abs(got.v - 1) < 0.05 and got.top >= 6 and abs(got.ab) < 0.03 and abs(got.ac) < 0.03


def test_one_long_series(spark):
    """200,000 rows of one key take seconds: no frame is read anew for each row."""
    import time

    rows = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 500, F.col("id").cast("double")).alias("v"))
    began = time.time()
    got = rows.select("t", I.locf(["k"], "t", "v").alias("a"), I.linear(["k"], "t", "v").alias("b")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    assert time.time() - began < 60 and got.a == sum(500 if t < 500 else (t - 500) // 1000 * 1000 + 500 for t in range(200_000))
    assert got.b == pytest.approx(sum(min(max(t, 500), 199_500) for t in range(200_000)))


def test_leave_one_out_mode(spark):
    from collections import Counter

    from quillmere.operators import labels as LB

    rng = random.Random(2)
    rows = [(i, rng.randrange(6), rng.choice([None, 1, 1, 2, 3])) for i in range(60)] + [(99, 9, 5)]
    got = {r.i: r.mode for r in LB.leave_one_out_mode(spark.createDataFrame(rows, "i int, k int, v int"), ["k"], "v").collect()}
    for i, k, _ in rows:
        others = Counter(v for j, kk, v in rows if kk == k and j != i and v is not None)
        assert got[i] == (min(others, key=lambda v: (-others[v], v)) if others else None)


def test_labels_and_manifest(spark):
    from quillmere.operators import labels as LB

    s = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "u string, t int, v int")
    m = spark.createDataFrame([("a", [True, False]), ("b", [False, True])], "u string, mask array<boolean>")
    got = LB.attach_validity(s, m, ["u"], ["t"])
    assert {(r.v, r.valid) for r in got.collect()} == {(10, True), (20, False), (30, None)}  # a mask of another length does not count
    assert {r.v for r in LB.only_valid(got).collect()} == {10, 30}
    with pytest.raises(ValueError):
        LB.with_manifest(s, m.where("u = 'a'"), ["u"], strict=True)
    assert LB.with_manifest(s, m.where("u = 'a'").select("u"), ["u"]).count() == 2
    assert LB.covariates(s, "v", {"v": ["t"]}).columns == ["u"]


def test_resampling(spark):
    rng = random.Random(4)
    errors = spark.createDataFrame([("m", u, rng.gauss(10, 2)) for u in range(200)], "method string, user_id long, e double")
    draws = L.bootstrap(errors, ["method"], "user_id", "e", 200)
    s = L.draw_summary(draws, ["method"]).first()
    values = [r.e for r in errors.collect()]
    assert abs(s.mean - np.mean(values)) < 0.1 and 0.5 < s.se / (np.std(values) / math.sqrt(200)) < 1.6
    left = L.jackknife(errors, ["method"], "user_id", "e")
    assert left.agg(F.avg("left_out")).first()[0] == pytest.approx(np.mean(values))
    point = errors.groupBy("method").agg(F.avg("e").alias("estimate"))
    b = L.bca(draws, left, point, ["method"]).first()
    assert b.low < b.estimate < b.high and abs(b.low - s.low) < 0.2


def test_features(spark):
    hours = [(1, h, 10 + 4 * math.cos(2 * math.pi * (h - 15) / 24)) for h in range(24 * 5)]
    got = FT.cosinor(spark.createDataFrame(hours, "k int, h long, v double"), ["k"], F.pmod("h", F.lit(24)), "v").first()
    assert got.mesor == pytest.approx(10) and got.amplitude == pytest.approx(4) and got.acrophase == pytest.approx(15) and got.r2 == pytest.approx(1)
    profile = FT.day_profile(spark.createDataFrame(hours, "k int, h long, v double"), ["k"], F.pmod("h", F.lit(24)), "v")
    c = profile.select(*[v.alias(k) for k, v in FT.circadian(F.col("profile")).items()]).first()
    assert c.acrophase == 15 and c.l5_onset == 1 and c.m10_onset in (10, 11)


def test_models():
    y = np.tile([1.0, 5.0, 3.0], 10)
    assert np.allclose(ML.holt_winters(y, 6, 3), np.tile([1.0, 5.0, 3.0], 2), atol=1.0)
    assert ML.holt_winters(np.full(5, 7.0), 3, 2).tolist() == [7.0] * 3 and ML.holt_winters(np.full(4, np.nan), 2, 2).tolist() == [0.0] * 2
    rng = np.random.default_rng(0)
    d = np.zeros(3000)
    for t in range(2, 3000):
        d[t] = 0.5 * d[t - 1] - 0.3 * d[t - 2] + rng.normal()
    assert np.allclose(ML.autoregression(np.cumsum(d))[:2], [0.5, -0.3], atol=0.06)
    assert np.isnan(ML.autoregression(np.arange(3.0))).all()


def test_contracts(spark):
    cells = spark.createDataFrame([(1, "c", t, float(t), t % 2 == 1) for t in range(6)], "user_id long, channel string, hour_idx long, v double, masked boolean")
    got = ML.impute_with(cells, ["user_id", "channel"], "hour_idx", "v", "masked", lambda x, m: np.full(len(x), np.nan), "none").collect()
    assert len(got) == 3 and all(r.is_fallback and r.pred == 2.0 for r in got)
    with pytest.raises(Exception, match="expected 6 values"):
        ML.impute_with(cells, ["user_id", "channel"], "hour_idx", "v", "masked", lambda x, m: x[:2], "short").collect()
    result = api.evaluate_imputation(cells, {"perfect": lambda x, m: np.where(m, np.arange(len(x)), x)})
    best = result.summary().orderBy("mean_rank").first()
    assert best.mean_rank <= 1.5 and "perfect" in {r.method for r in result.summary().collect()}
    assert api.list_masking_scenarios() and api.list_tasks(cells.withColumnRenamed("v", "task")) == ["channel", "hour_idx", "task", "masked"]
