"""Event and peak detection; sequential rules are folds over each ordered group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import AFTER, islands, ordered, whole


def local_peaks(df: DataFrame, keys, x: str, order, least: float) -> DataFrame:
    """Samples above ``least`` that exceed the one before and are no lower than the one after."""
    w = ordered(keys, order)
    return df.where(F.col(x).isNotNull()).withColumn("_p", F.lag(x).over(w)).withColumn("_n", F.lead(x).over(w)).where(
        (F.col(x) >= least) & (F.col(x) > F.col("_p")) & (F.col(x) >= F.col("_n"))).drop("_p", "_n")


def habituation(df: DataFrame, keys, x: str, order) -> DataFrame:
    """Slope of log amplitude on trial number and the ratio of the last to the first third's mean."""
    w = ordered(keys, order)
    d = df.withColumn("trial", F.row_number().over(w)).withColumn("third", F.ntile(3).over(w))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.log1p(x), F.col("trial").cast("double")).alias("slope"),
                                F.try_divide(F.avg(F.when(F.col("third") == 3, F.col(x))), F.avg(F.when(F.col("third") == 1, F.col(x)))).alias("ratio"))


def fixations(df: DataFrame, keys, x: str, y: str, t: str, order, speed: float, longest_gap: float, least: float, kind: str = "fixation") -> DataFrame:
    """I-VT: the larger of the two neighbouring velocities classifies a sample; runs of one class become events."""
    w = ordered(keys, order)
    dt = F.col(t) - F.lag(t).over(w)
    d = df.withColumn("_dt", dt).withColumn("_v", F.when((dt > 0) & (dt <= longest_gap), F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / dt))
    v = F.greatest("_v", F.lead("_v").over(w))
    gap = (F.col("_dt") > longest_gap) | (F.lead("_dt").over(w) > longest_gap)
    d = d.withColumn("class", F.when(v.isNull() | F.coalesce(gap, F.lit(False)), "none").when(v <= speed, "fixation").otherwise("saccade"))
    d = islands(d, F.col("class"), keys, order)
    r = d.groupBy(*keys, "run", "class").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    return r.where((F.col("class") == kind) & (F.col("stop") - F.col("start") >= least)).drop("run", "class").withColumn("duration", F.col("stop") - F.col("start"))


def marker_onsets(df: DataFrame, keys, active, t: str, order) -> DataFrame:
    """Rising edges of a marker with the time until it is inactive again."""
    w = ordered(keys, order)
    d = df.withColumn("_a", active).withColumn("_was", F.lag("_a").over(w))
    off = F.first(F.when(~F.col("_a"), F.col(t)), ignorenulls=True).over(ordered(keys, order, 1, AFTER))
    return d.withColumn("duration", off - F.col(t)).where(F.col("_a") & ~F.coalesce("_was", F.lit(False))).drop("_a", "_was")


def combine_markers(df: DataFrame, keys, t: str, marker: str) -> DataFrame:
    """Markers of one time joined into one, in order."""
    return df.groupBy(*keys, t).agg(F.array_join(F.sort_array(F.collect_set(marker)), "+").alias("markers"), F.count("*").alias("n"))


def changepoints(df: DataFrame, keys, x: str, order, half: int, k: float) -> DataFrame:
    """Difference of the means after and before each sample; scores over k times the group's mean absolute score."""
    d = df.withColumn("score", F.abs(F.avg(x).over(ordered(keys, order, 1, half)) - F.avg(x).over(ordered(keys, order, -half, -1))))
    return d.withColumn("limit", k * F.avg("score").over(whole(keys))).where(F.col("score") > F.col("limit"))


def scr_interval(latency) -> F.Column:
    """FIR and SIR windows are half-open, TIR is closed."""
    return F.when((latency >= 1) & (latency < 5), "FIR").when((latency >= 5) & (latency < 9), "SIR").when((latency >= 9) & (latency <= 12), "TIR")
