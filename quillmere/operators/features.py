"""User features from hourly arrays and daily totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.columns import array_total, circular_sums, first_index, ratio


def day_profile(rows: DataFrame, keys: list[str], hour: Column, value: str, period: int = 24, order: list[str] | None = None) -> DataFrame:
    """A key's sums by hour of day as one array; hours without rows are 0.

    With `order` each hour is added up row by row in that order. Sums of doubles depend on the order in their last bits, so
    without it two hours of equal totals may compare either way, as rows happen to be dealt.
    """
    rows = rows.withColumn("_h", hour)
    if order:
        w = Window.partitionBy(*keys, "_h").orderBy(*order)
        running = rows.withColumn("_r", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
        sums = running.groupBy(*keys, "_h").agg(F.max_by("_r", "_n").alias("_v"))
    else:
        sums = rows.groupBy(*keys, "_h").agg(F.sum(value).alias("_v"))
    by = F.map_from_entries(F.collect_list(F.struct("_h", "_v")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda h: F.coalesce(F.try_element_at(F.col("_m"), h.cast("long")), F.lit(0.0)))
    return sums.groupBy(*keys).agg(by.alias("_m")).select(*keys, filled.alias("profile"))


def circadian(profile: Column) -> dict[str, Column]:
    """Least active 5 hours, most active 10, their onsets, relative amplitude and the hour of the peak; NULL without activity."""
    l5, m10 = circular_sums(profile, 5), circular_sums(profile, 10)
    low, high = F.array_min(l5) / 5, F.array_max(m10) / 10
    live = array_total(profile) > 0
    parts = {"l5": low, "l5_onset": first_index(l5, F.array_min(l5)), "m10": high, "m10_onset": first_index(m10, F.array_max(m10)), "relative_amplitude": ratio(high - low, high + low), "acrophase": first_index(profile, F.array_max(profile))}
    return {k: F.when(live, v) for k, v in parts.items()}


def rmssd(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Root mean square of successive differences."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_d", d).groupBy(key).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"))


def moments(x: str) -> list[Column]:
    """N, RMS, variance, deviation, power, peak, peak to peak, crest, population skewness and excess kurtosis."""
    flat = F.var_pop(x) > 0
    return [
        F.count(x).alias("n"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("deviation"), F.avg(F.col(x) * F.col(x)).alias("power"),
        F.max(F.abs(F.col(x))).alias("peak"), (F.max(x) - F.min(x)).alias("peak_to_peak"), ratio(F.max(F.abs(F.col(x))), F.sqrt(F.avg(F.col(x) * F.col(x)))).alias("crest"),
        F.when(flat, F.skewness(x)).alias("skew"), F.when(flat, F.kurtosis(x)).alias("kurt"),
    ]


def interdaily_stability(rows: DataFrame, key: str, hour: Column, value: str) -> DataFrame:
    """Variance of hourly means over total variance, from per-hour counts, sums and squares."""
    per = rows.withColumn("_h", hour).groupBy(key, "_h").agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    between = F.avg(F.pow(F.col("_s") / F.col("_n"), 2)) - F.pow(F.avg(F.col("_s") / F.col("_n")), 2)
    return per.groupBy(key).agg(ratio(between, q / n - F.pow(s / n, 2)).alias("stability"))


def cosinor(rows: DataFrame, keys: list[str], hour: Column, value: str, least: int = 20) -> DataFrame:
    """MESOR, amplitude and acrophase of a 24-hour cosine by least squares, R squared and the F test's p.

    Normal equations from seven sums, solved in closed form; with two and m degrees of freedom p is (1 + 2F/m)^(-m/2).
    """
    w = 2 * 3.141592653589793 / 24
    r = rows.withColumn("_c", F.cos(hour * w)).withColumn("_s", F.sin(hour * w)).withColumn("_y", F.col(value))
    mean = lambda x: F.avg(x)
    m = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mean("_c").alias("c"), mean("_s").alias("s"), mean("_y").alias("y"), mean(F.col("_c") * F.col("_c")).alias("cc"), mean(F.col("_s") * F.col("_s")).alias("ss"),
        mean(F.col("_c") * F.col("_s")).alias("cs"), mean(F.col("_c") * F.col("_y")).alias("cy"), mean(F.col("_s") * F.col("_y")).alias("sy"), mean(F.col("_y") * F.col("_y")).alias("yy"),
    ).where(F.col("n") >= least)
    c = F.col
    vcc, vss, vcs, vcy, vsy, vyy = (c(f"{a}{b}") - c(a) * c(b) for a, b in ("cc", "ss", "cs", "cy", "sy", "yy"))
    m = m.select(*keys, "n", "c", "s", "y", vcc.alias("vcc"), vss.alias("vss"), vcs.alias("vcs"), vcy.alias("vcy"), vsy.alias("vsy"), vyy.alias("vyy"))
    det = c("vcc") * c("vss") - c("vcs") * c("vcs")
    m = m.where(det > 1e-12).withColumn("beta", (c("vcy") * c("vss") - c("vsy") * c("vcs")) / det).withColumn("gamma", (c("vsy") * c("vcc") - c("vcy") * c("vcs")) / det)
    fit = c("beta") * c("vcy") + c("gamma") * c("vsy")
    m = m.withColumn("r2", ratio(fit, c("vyy")))
    f_stat = c("r2") / 2 / ((1 - c("r2")) / (c("n") - 3))
    return m.select(
        *keys, "n", (c("y") - c("beta") * c("c") - c("gamma") * c("s")).alias("mesor"), F.sqrt(c("beta") ** 2 + c("gamma") ** 2).alias("amplitude"), F.pmod(F.atan2("gamma", "beta") / w, F.lit(24.0)).alias("acrophase"), "r2",
        F.when(c("r2") < 1, F.pow(1 + 2 * f_stat / (c("n") - 3), -(c("n") - 3) / 2)).alias("p_value"),
    )


def cross_correlation(rows: DataFrame, key: str, order: str, x: str, y: str, lags: int) -> DataFrame:
    """Biased cross-correlation at lags 0 to `lags`: x against y that many steps on."""
    w = Window.partitionBy(key)
    z = rows.withColumn("_x", F.col(x) - F.avg(x).over(w)).withColumn("_y", F.col(y) - F.avg(y).over(w))
    for k in range(lags + 1):
        z = z.withColumn(f"_y{k}", F.lead("_y", k).over(w.orderBy(order)) if k else F.col("_y"))
    ahead = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_y{k}").alias("v")) for k in range(lags + 1)]))
    return z.withColumn("_e", ahead).groupBy(key, F.col("_e.lag").alias("lag")).agg(ratio(F.sum(F.col("_x") * F.col("_e.v")) / F.count(F.lit(1)), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("ccf"))


def weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def autoregression(rows: DataFrame, key: str, order: str, value: str, least: int = 4) -> DataFrame:
    """ar1, ar2 and intercept of an autoregression of first differences, by least squares from means and covariances."""
    w = Window.partitionBy(key).orderBy(order)
    y = rows.withColumn("_y", F.col(value) - F.lag(value).over(w))
    laid = y.withColumn("_a", F.lag("_y").over(w)).withColumn("_b", F.lag("_y", 2).over(w)).where("_b IS NOT NULL")
    m = laid.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_ym"), F.avg("_a").alias("_am"), F.avg("_b").alias("_bm"), F.var_pop("_a").alias("_aa"), F.var_pop("_b").alias("_bb"),
        F.covar_pop("_a", "_b").alias("_ab"), F.covar_pop("_y", "_a").alias("_ya"), F.covar_pop("_y", "_b").alias("_yb"),
    )
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    ok = (F.col("_n") >= least) & (det > 1e-9 * F.col("_aa") * F.col("_bb"))
    first = F.when(ok, (F.col("_ya") * F.col("_bb") - F.col("_yb") * F.col("_ab")) / det)
    second = F.when(ok, (F.col("_yb") * F.col("_aa") - F.col("_ya") * F.col("_ab")) / det)
    fitted = m.withColumn("ar1", first).withColumn("ar2", second).withColumn("intercept", F.col("_ym") - F.col("ar1") * F.col("_am") - F.col("ar2") * F.col("_bm"))
    return rows.select(key).distinct().join(fitted.select(key, "ar1", "ar2", "intercept"), key, "left")
