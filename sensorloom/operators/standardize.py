"""Standardisation, baseline, smoothing, imputation, sessions. Order-dependent operators take ``order``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import BEFORE, islands, last_known, median, next_known, ordered, quantile, robust, whole
from ..functions.ranges import kept, matched

#: Tables of at most this many rows are sent to all executors.
FEW = 10_000


def zscore(df: DataFrame, keys, x: str, min_valid: int = 3) -> DataFrame:
    """z by group (ddof 1); status ok, too_few or zero_sd, NULL where not ok."""
    w = whole(keys)
    n, m, s = F.count(x).over(w), F.avg(x).over(w), F.stddev_samp(x).over(w)
    status = F.when(n < min_valid, "too_few").when((s == 0) | s.isNull(), "zero_sd").otherwise("ok")
    return df.withColumn("z_status", status).withColumn("z", F.when(F.col("z_status") == "ok", (F.col(x) - m) / s))


def range_correction(df: DataFrame, keys, x: str, zero_range: float | None = None) -> DataFrame:
    w = whole(keys)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn("ranged", F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(F.lit(zero_range).cast("double")))


def within_unit(df: DataFrame, keys, x: str, reference: Column) -> DataFrame:
    """Centre and scale by the rows of a reference subset."""
    r, w = F.when(reference, F.col(x)), whole(keys)
    s = F.stddev_samp(r).over(w)
    return df.withColumn("scaled", F.when(s > 0, (F.col(x) - F.avg(r).over(w)) / s))


def normalize(df: DataFrame, keys, x: str, method: str) -> DataFrame:
    """z, percent_max, range, center or log_z; groups without spread give 0."""
    w = whole(keys)
    v = F.log1p(F.greatest(F.col(x), F.lit(0.0))) if method == "log_z" else F.col(x)
    zero = lambda top, by: F.when(v.isNotNull(), F.coalesce(F.when(by > 0, top / by), F.lit(0.0)))
    y = {
        "z": lambda: zero(v - F.avg(v).over(w), F.stddev_samp(v).over(w)),
        "log_z": lambda: zero(v - F.avg(v).over(w), F.stddev_samp(v).over(w)),
        "percent_max": lambda: zero(100 * v, F.max(v).over(w)),
        "range": lambda: zero(v - F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)),
        "center": lambda: v - F.avg(v).over(w),
    }[method]()
    return df.withColumn("normalized", y)


def baseline_correct(df: DataFrame, keys, x: str, baseline: Column, how: str = "mean") -> DataFrame:
    b = F.when(baseline & (F.col(x) != 0), F.col(x))
    base = (F.avg(b) if how == "mean" else median(b)).over(whole(keys))
    return df.withColumn("baseline", base).withColumn("corrected", F.col(x) - F.col("baseline"))


def smooth(df: DataFrame, keys, x: str, order, width: int, how: str = "mean") -> DataFrame:
    """Centred odd window, shrunk at the edges."""
    h = width // 2
    w = ordered(keys, order, -h, h)
    return df.withColumn("smooth", (F.avg(x) if how == "mean" else median(x)).over(w))


def detrend(df: DataFrame, keys, x: str, t: str) -> DataFrame:
    """Residuals of a straight line in time."""
    w = whole(keys)
    both = F.when(F.col(x).isNotNull(), F.col(t))
    return df.withColumn("detrended", F.col(x) - F.coalesce(F.regr_intercept(x, both).over(w) + F.regr_slope(x, both).over(w) * F.col(t), F.avg(x).over(w)))


def tonic_phasic(df: DataFrame, keys, x: str, order, width: int, k: float = 3.0) -> DataFrame:
    """Rolling-median tonic part, phasic rest, and peaks over k scaled MADs."""
    d = smooth(df, keys, x, order, width, "median").withColumnRenamed("smooth", "tonic").withColumn("phasic", F.col(x) - F.col("tonic"))
    d = robust(d, keys, "phasic", "_m", "threshold")
    w = ordered(keys, order)
    up = F.coalesce(F.col("phasic") > F.lag("phasic").over(w), F.lit(True)) & F.coalesce(F.col("phasic") >= F.lead("phasic").over(w), F.lit(True))
    return d.withColumn("peak", F.coalesce(up & (F.col("phasic") - F.col("_m") > k * F.col("threshold")), F.lit(False))).drop("_m")


def impute(df: DataFrame, keys, x: str, t: str, order, method: str = "linear", max_gap: int | None = None) -> DataFrame:
    """Fills missing samples; runs longer than ``max_gap`` samples stay missing, as do open ends for linear."""
    d = islands(df, F.col(x).isNull(), keys, order)
    at = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    d = d.withColumn("_p", last_known(at, keys, order)).withColumn("_n", next_known(at, keys, order))
    size = F.count("*").over(whole([*keys, "run"]))
    p, n = F.col("_p"), F.col("_n")
    part = F.try_divide(F.col(t) - p["t"], n["t"] - p["t"])
    fill = {
        "linear": p["x"] + F.coalesce(part, F.lit(0.0)) * (n["x"] - p["x"]),
        "locf": p["x"],
        "nocb": n["x"],
        "nearest": F.when(p.isNull(), n["x"]).when(n.isNull(), p["x"]).when(F.col(t) - p["t"] <= n["t"] - F.col(t), p["x"]).otherwise(n["x"]),
    }[method]
    ok = F.col(x).isNull() if max_gap is None else F.col(x).isNull() & (size <= max_gap)
    return d.withColumn("imputed", F.when(ok, fill).otherwise(F.col(x))).withColumn("was_imputed", F.col(x).isNull() & F.col("imputed").isNotNull()).drop("_p", "_n", "run")


def time_resets(df: DataFrame, keys, t: str, order) -> DataFrame:
    """Backward and repeated steps, and the segment each row belongs to."""
    d = df.withColumn("dt", F.col(t) - F.lag(t).over(ordered(keys, order)))
    d = d.withColumn("is_reset", F.coalesce(F.col("dt") < 0, F.lit(False))).withColumn("is_tie", F.coalesce(F.col("dt") == 0, F.lit(False)))
    return d.withColumn("segment", F.sum(F.col("is_reset").cast("long")).over(ordered(keys, order, BEFORE, 0)))


def sessions(df: DataFrame, keys, t: str, order, gap: float) -> DataFrame:
    """A new session after a backward step or a gap."""
    dt = F.col(t) - F.lag(t).over(ordered(keys, order))
    d = df.withColumn("_new", F.coalesce(((dt < 0) | (dt > gap)).cast("long"), F.lit(0)))
    return d.withColumn("session", 1 + F.sum("_new").over(ordered(keys, order, BEFORE, 0))).drop("_new")


def merge_recordings(df: DataFrame, recording: str, t: str, pause: float = 1.0) -> DataFrame:
    """Recordings one after the other on one clock: each starts ``pause`` after the last one's end."""
    span = df.groupBy(recording).agg(F.min(t).alias("_t0"), (F.max(t) - F.min(t) + pause).alias("_len"))  # one row a recording
    span = span.withColumn("_at", F.coalesce(F.sum("_len").over(ordered([], [recording], BEFORE, -1)), F.lit(0.0)))
    return df.join(span, recording).withColumn("merged_t", F.col("_at") + F.col(t) - F.col("_t0")).drop("_t0", "_len", "_at")


def chunks(df: DataFrame, keys, t: str, width: float) -> DataFrame:
    """Numbered chunks of each group; a chunk is complete if a sample reaches its end or a later chunk exists."""
    d = df.withColumn("t0", F.min(t).over(whole(keys)))
    d = d.withColumn("chunk", (F.floor((F.col(t) - F.col("t0")) / width) + 1).cast("long"))
    return d.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("stop"), F.first("t0").alias("t0")).withColumn(
        "complete", F.col("stop") >= F.col("t0") + F.col("chunk") * width).drop("t0")


def stabilization(df: DataFrame, keys, t: str, period: float) -> DataFrame:
    return df.withColumn("settling", F.col(t) < F.min(t).over(whole(keys)) + period)


def asymmetry(df: DataFrame, left: str, right: str) -> DataFrame:
    """Left-right difference, its size, share and log ratio."""
    a, b = F.col(left), F.col(right)
    return df.withColumn("diff", a - b).withColumn("share", F.try_divide(a - b, a + b)).withColumn("log_ratio", F.when((a > 0) & (b > 0), F.ln(a / b)))


def linear_residual(df: DataFrame, keys, y: str, x: str) -> DataFrame:
    """Residual of y on one predictor, around y's mean.

    Fits are aggregated and meet the rows by their keys, so that a group of any size stays spread.
    """
    xx, yy = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    fits = kept(df.groupBy(*keys).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_slope"), F.avg(xx).alias("_centre"), F.avg(yy).alias("fit_mean")))
    if fits.limit(FEW + 1).count() <= FEW:
        fits = F.broadcast(fits)
    return matched(df, fits, keys).withColumn("residual", F.col(y) - F.col("_slope") * (F.col(x) - F.col("_centre"))).drop("_slope", "_centre").select(*df.columns, "residual", "fit_mean")


def interior_fill(df: DataFrame, keys, x: str, t: str, order) -> DataFrame:
    """Linear interpolation inside the recording only; missing ends stay missing."""
    return impute(df, keys, x, t, order, "linear")


def hampel(df: DataFrame, keys, x: str, order, width: int, k: float) -> DataFrame:
    """Running median; samples whose residual exceeds k scaled MADs of the residuals take the median."""
    d = smooth(df, keys, x, order, width, "median").withColumn("_r", F.col(x) - F.col("smooth"))
    d = robust(d, keys, "_r", "_c", "_s").withColumn("replaced", F.abs(F.col("_r") - F.col("_c")) > k * F.col("_s"))
    return d.withColumn("clean", F.when(F.col("replaced"), F.col("smooth")).otherwise(F.col(x))).drop("_r", "_c", "_s")


def anonymize(df: DataFrame, column: str, prefix: str = "P", width: int = 4) -> DataFrame:
    """Sorted distinct ids become prefix and zero-padded rank; only the id list is ranked."""
    ids = df.select(column).distinct().withColumn("anon", F.concat(F.lit(prefix), F.lpad(F.row_number().over(ordered([], [column])).cast("string"), width, "0")))
    return df.join(ids, column)



def tone_angle(lightness: Column, yellow: Column) -> Column:
    """Individual typology angle in degrees, with its limits where the yellow axis is 0."""
    return F.when(yellow != 0, F.degrees(F.atan((lightness - 50) / yellow))).when(lightness > 50, 90.0).when(lightness < 50, -90.0)


def robust_scale(df: DataFrame, keys, x: str) -> DataFrame:
    """Centred by the median and scaled by the IQR; no spread gives NULL."""
    w = whole(keys)
    return df.withColumn("robust", F.try_divide(F.col(x) - median(x).over(w), F.nullif(quantile(x, 0.75).over(w) - quantile(x, 0.25).over(w), F.lit(0.0))))


def trim(df: DataFrame, keys, t: str, start: float, stop: float) -> DataFrame:
    """Rows whose time since their group's first is in [start, stop), with that time."""
    return df.withColumn("rel_t", F.col(t) - F.min(t).over(whole(keys))).where((F.col("rel_t") >= start) & (F.col("rel_t") < stop))
