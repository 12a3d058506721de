"""Heart-rate variability over ordered NN intervals (ms) and other sequence features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import home, in_blocks, near
from ..functions.core import BEFORE, islands, ordered, whole
from ..functions.ranges import matched, running


def nn_diff(df: DataFrame, keys, x: str, order) -> DataFrame:
    """Valid intervals with their successive differences, taken after invalid rows are dropped."""
    return df.where(F.col(x) > 0).withColumn("d", F.col(x) - F.lag(x).over(ordered(keys, order)))


def _seconds(x: str, keys, order) -> Column:
    """Cumulative time in seconds of intervals in ms, to a millionth of one, so that a beat on a border does not depend on how the sum was made."""
    return F.round(F.sum(x).over(ordered(keys, order, BEFORE, 0)), 6) / 1000.0


def time_domain(df: DataFrame, keys, x: str, order) -> DataFrame:
    """Counts, mean, extremes, SDNN, RMSSD, SDSD, NN50, NN20, their percentages, and mean heart rate."""
    d = nn_diff(df, keys, x, order)
    a = F.abs("d")
    return d.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean_nn"), F.min(x).alias("min_nn"), F.max(x).alias("max_nn"), F.stddev_samp(x).alias("sdnn"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"),
        F.stddev_samp("d").alias("sdsd"), F.count_if(a > 50).alias("nn50"), F.count_if(a > 20).alias("nn20"), F.try_divide(100.0 * F.count_if(a > 50), F.count("d")).alias("pnn50"),
        F.try_divide(100.0 * F.count_if(a > 20), F.count("d")).alias("pnn20"), F.avg(60000.0 / F.col(x)).alias("mean_hr"))


def segment_indices(df: DataFrame, keys, x: str, order, seconds: float) -> DataFrame:
    """SDNN index (mean of segment SDs) and SDANN (SD of segment means) over fixed segments of cumulative time."""
    d = df.where(F.col(x) > 0).withColumn("_t", _seconds(x, keys, order))
    s = d.groupBy(*keys, F.floor(F.col("_t") / seconds).alias("_s")).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return s.groupBy(*keys).agg(F.count("*").alias("segments"), F.avg("s").alias("sdnn_index"), F.stddev_samp("m").alias("sdann"))


def geometric(df: DataFrame, keys, x: str, bin_ms: float = 7.8125) -> DataFrame:
    """Triangular index (n over the largest bin) and the range of the non-empty bins' centres."""
    b = df.where(F.col(x) > 0).groupBy(*keys, F.floor(F.col(x) / bin_ms).alias("b")).agg(F.count("*").alias("k"))
    return b.groupBy(*keys).agg((F.sum("k") / F.max("k")).alias("triangular_index"), ((F.max("b") - F.min("b")) * F.lit(bin_ms)).alias("tinn"))


def poincare(df: DataFrame, keys, x: str, order) -> DataFrame:
    d = nn_diff(df, keys, x, order).groupBy(*keys).agg(F.var_samp("d").alias("vd"), F.var_samp(x).alias("vx"), F.count("d").alias("n"))
    sd1, sd2 = F.sqrt(F.col("vd") / 2), F.sqrt(F.greatest(2 * F.col("vx") - F.col("vd") / 2, F.lit(0.0)))
    return d.select(*keys, "n", sd1.alias("sd1"), sd2.alias("sd2")).withColumn("ratio", F.try_divide("sd1", "sd2")).withColumn("area", F.lit(math.pi) * F.col("sd1") * F.col("sd2"))


def fragmentation(df: DataFrame, keys, x: str, order) -> DataFrame:
    """Share of inflection points, inverse mean segment length, shares of differences in segments of three or fewer and of one, from signs of non-zero differences."""
    d = nn_diff(df, keys, x, order).where("d <> 0").withColumn("s", F.signum("d").cast("int"))
    r = islands(d, F.col("s"), keys, order).groupBy(*keys, "run").agg(F.count("*").alias("len"))
    n, total = F.count("*"), F.sum("len")
    return r.groupBy(*keys).agg(
        F.try_divide(100.0 * (n - 1), total - 1).alias("pip"), (n / total).alias("ials"), (100.0 * F.sum(F.when(F.col("len") <= 3, F.col("len")).otherwise(0)) / total).alias("pss"),
        (100.0 * F.count_if(F.col("len") == 1) / total).alias("pas"))


def asymmetry(df: DataFrame, keys, x: str, order) -> DataFrame:
    """Counts of accelerations and decelerations, Guzik's and Porta's indices."""
    d = nn_diff(df, keys, x, order)
    up, down = F.col("d") > 0, F.col("d") < 0
    sq = F.col("d") * F.col("d")
    return d.groupBy(*keys).agg(
        F.count_if(down).alias("accelerations"), F.count_if(up).alias("decelerations"), F.try_divide(100.0 * F.sum(F.when(up, sq)), F.sum(F.when(F.col("d") != 0, sq))).alias("guzik"),
        F.try_divide(100.0 * F.count_if(down), F.count_if(F.col("d") != 0)).alias("porta"))


def lomb(df: DataFrame, keys, x: str, t: str, frequencies) -> DataFrame:
    """Lomb power on a frequency grid as sums of sine and cosine products; each sample meets the grid once."""
    c = df.where(F.col(x).isNotNull()).withColumn("y", F.col(x) - F.avg(x).over(whole(keys)))
    g = c.withColumn("f", F.explode(F.array(*[F.lit(float(f)) for f in frequencies]))).withColumn("w", F.lit(2 * math.pi) * F.col("f") * F.col(t))
    s = g.groupBy(*keys, "f").agg(*[F.sum(e).alias(n) for n, e in (
        ("yc", F.col("y") * F.cos("w")), ("ys", F.col("y") * F.sin("w")), ("cc", F.cos("w") * F.cos("w")), ("ss", F.sin("w") * F.sin("w")))])
    return s.select(*keys, "f", (0.5 * (F.coalesce(F.try_divide(F.col("yc") * F.col("yc"), F.col("cc")), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("ys") * F.col("ys"), F.col("ss")), F.lit(0.0)))).alias("power"))


BANDS = {"ulf": (0.0, 0.003), "vlf": (0.003, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}


def resampled(df: DataFrame, keys, x: str, order, rate: float, low: float = 250.0, high: float = 2500.0) -> DataFrame:
    """(keys, j, y): intervals (ms) within ``low`` to ``high``, drawn as straight lines over their cumulative time and read every 1 / ``rate`` seconds from the first beat on.

    Places and times come from sums by ranges, so a recording is spread; each beat
    gives the points up to the next one. Recordings of under four intervals have none.
    """
    d = df.where(F.col(x).between(low, high)).select(*keys, *order, F.col(x).cast("double").alias("_x"))
    d = running(d, keys, order, rn=F.lit(1).cast("long"), ms=F.col("_x")).where("rn_total >= 4")
    first = d.where("rn_before = 0").select(*keys, F.col("_x").alias("_first"))
    d = matched(d, first, keys).select(*keys, F.col("rn_before").alias("rn"), "_x", F.round((F.col("ms_before") + F.col("_x") - F.col("_first")) / 1000, 9).alias("_a"))
    ahead = lambda c: F.first(c).over(near(keys, "rn", 1, 1))
    d = home(in_blocks(d, "rn", 1024, 1).withColumn("_b", ahead("_a")).withColumn("_z", ahead("_x")))
    up = lambda c: F.ceil(F.col(c) * rate - 1e-9)
    d = d.withColumn("_lo", up("_a").cast("long")).withColumn("_hi", F.coalesce(up("_b") - 1, F.floor(F.col("_a") * rate + 1e-9)).cast("long")).where("_lo <= _hi")
    d = d.withColumn("j", F.explode(F.sequence("_lo", "_hi")))
    share = F.coalesce((F.col("j") / rate - F.col("_a")) / (F.col("_b") - F.col("_a")), F.lit(0.0))
    return d.select(*keys, "j", (F.col("_x") + F.coalesce(F.col("_z") - F.col("_x"), F.lit(0.0)) * share).alias("y"))


def welch(points: DataFrame, keys, rate: float, window: float = 256.0, overlap: float = 0.5, most: float = 0.4) -> DataFrame:
    """(keys, f, power): mean power of Hann-tapered segments of ``window`` seconds (at least 8 points, or all of a shorter recording) below ``most`` Hz and half the rate.

    Segments begin every (1 - ``overlap``) of their size; a point goes to those that hold
    it, and each transform is a sum of products, so a recording is spread over its segments. Zero frequency has no power.
    Recordings of under 8 points have no spectrum.
    """
    about = points.groupBy(*keys).agg((F.max("j") + 1).alias("_n"), F.avg("y").alias("_mean")).where("_n >= 8")
    size = F.least(F.col("_n"), F.lit(max(8, round(window * rate))))
    d = matched(points, about, keys).withColumn("_size", size).withColumn("_step", F.greatest(F.lit(1), F.bround(F.col("_size") * (1 - overlap), 0).cast("long")))
    last = F.floor((F.col("_n") - F.col("_size")) / F.col("_step"))
    d = d.withColumn("_from", F.greatest(F.lit(0), F.ceil((F.col("j") - F.col("_size") + 1) / F.col("_step"))).cast("long")).withColumn("_to", F.least(last, F.floor(F.col("j") / F.col("_step"))).cast("long")).where("_from <= _to")
    d = d.withColumn("_segment", F.explode(F.sequence("_from", "_to"))).withColumn("_i", F.col("j") - F.col("_segment") * F.col("_step"))
    d = d.withColumn("_y", (F.col("y") - F.col("_mean")) * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("_i") / (F.col("_size") - 1))))
    bins = F.least(F.floor(F.col("_size") / 2) - 1, F.ceil(F.lit(most) * F.col("_size") / rate)).cast("long")
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), bins)))
    angle = 2 * math.pi * F.col("_k") * F.col("_i") / F.col("_size")
    s = d.groupBy(*keys, "_size", "_segment", "_k").agg(F.sum(F.col("_y") * F.cos(angle)).alias("_c"), F.sum(F.col("_y") * F.sin(angle)).alias("_s"))
    p = s.groupBy(*keys, (F.col("_k") * rate / F.col("_size")).alias("f")).agg((F.avg(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / (F.first("_size") * rate)).alias("power"))
    return p.unionByName(about.select(*keys, F.lit(0.0).alias("f"), F.lit(0.0).alias("power"))).where(F.col("f") < most)


def frequency_domain(df: DataFrame, keys, x: str, order, rate: float = 4.0, window: float = 256.0) -> DataFrame:
    """Band powers of the evenly resampled intervals (ms): absolute (trapezoids between the bins of a band), relative, normalised, their ratio and peak frequencies.

    A band of fewer than two bins has no power (NULL), one without a bin no peak. Every
    recording has a row; without a spectrum its total is 0 and all else NULL.
    """
    p = welch(resampled(df, keys, x, order, rate), keys, rate, window, most=max(hi for _, hi in BANDS.values()))
    inside = lambda b: (F.col("f") >= BANDS[b][0]) & (F.col("f") < BANDS[b][1])
    band = F.coalesce(*[F.when(inside(b), b) for b in BANDS])
    p = p.withColumn("_band", band)
    w = ordered([*keys, "_band"], ["f"])
    p = p.withColumn("_area", (F.col("f") - F.lag("f").over(w)) * (F.col("power") + F.lag("power").over(w)) / 2)
    of = lambda b, e: F.when(F.col("_band") == b, e)
    areas = [F.sum(of(b, F.col("_area"))).alias(f"{b}_abs") for b in BANDS]
    peaks = [F.max(of(b, F.struct("power", (-F.col("f")).alias("g"))))["g"].alias(f"{b}_peak") for b in BANDS]
    s = p.groupBy(*keys).agg(*areas, *peaks).withColumn("total_power", sum((F.coalesce(f"{b}_abs", F.lit(0.0)) for b in BANDS), F.lit(0.0)))
    part = lambda a, whole_: F.when(whole_ > 0, 100 * F.col(a) / whole_)
    both = F.col("lf_abs") + F.col("hf_abs")
    s = s.select(*keys, "total_power", *[f"{b}_abs" for b in BANDS], *[part(f"{b}_abs", F.col("total_power")).alias(f"{b}_rel") for b in BANDS], part("lf_abs", both).alias("lf_norm"), part("hf_abs", both).alias("hf_norm"),
                 F.when(F.col("hf_abs") > 0, F.col("lf_abs") / F.col("hf_abs")).alias("lf_hf"), *[(-F.col(f"{b}_peak")).alias(f"{b}_peak") for b in BANDS])
    return matched(df.select(*keys).distinct(), s, keys, "left").withColumn("total_power", F.coalesce("total_power", F.lit(0.0)))


def sliding_segments(df: DataFrame, keys, x: str, order, width: float, step: float, least: int) -> DataFrame:
    """Overlapping segments [k step, k step + width) of cumulative time; each beat joins the few that hold it."""
    d = df.where(F.col(x) > 0).withColumn("_t", _seconds(x, keys, order))
    first = F.greatest(F.floor((F.col("_t") - width) / step) + 1, F.lit(0))
    d = d.withColumn("segment", F.explode(F.sequence(first, F.floor(F.col("_t") / step))))
    return d.groupBy(*keys, "segment").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).where(F.col("n") >= least)


def inverse_gaussian(df: DataFrame, keys, x: str) -> DataFrame:
    """Maximum-likelihood mean and shape of an inverse Gaussian of the intervals."""
    d = df.where(F.col(x) > 0)
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mu"), F.sum(1 / F.col(x)).alias("_i"))
    return s.withColumn("shape", F.try_divide(F.col("n").cast("double"), F.col("_i") - F.col("n") / F.col("mu"))).drop("_i")
