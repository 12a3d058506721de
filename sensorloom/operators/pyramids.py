"""Dyadic pyramids: power of heart-rate intervals by scale, and shrinkage of skin-conductance detail."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, functions as F

from ..functions.core import finite, last_known, median, next_known, ordered, whole
from ..functions.ranges import matched, running
from .tiles import places

# Frequency bands in Hz.
BANDS = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.40)}


def wavelet_power(df: DataFrame, keys, x: str, order, least: int = 8) -> DataFrame:
    """(keys, scale_beats, pseudo_frequency_hz, period_beats, n_coefficients, wavelet_power) at scales 1, 2, 4 ... of a quarter of the intervals.

    A coefficient is the mean of ``scale`` intervals less the mean of the next as
    many, at every place. All levels come from one prefix sum, found by ranges:
    each row adds its own to the three coefficients that it bounds, so one shuffle
    by (scale, place) holds the pyramid. Intervals with a median over 10 are
    milliseconds. Groups under ``least`` intervals have no rows.
    """
    keys = list(keys)
    p = places(df, keys, finite(F.col(x).cast("double")), order).where(F.col("n") >= least)
    mid = p.groupBy(*keys).agg(median("v").alias("_mid"))
    unit = F.when(F.col("_mid") > 10, 1000.0).otherwise(1.0)
    p = matched(p, mid, keys).withColumn("v", F.col("v") / unit).withColumn("_mid", F.col("_mid") / unit)
    p = running(p, keys, ["rn"], c=F.col("v"))
    ends = F.array(F.struct(F.col("rn").alias("at"), F.col("c_before").alias("c")), F.when(F.col("rn") == F.col("n") - 1, F.struct(F.col("n").alias("at"), F.col("c_total").alias("c"))))
    p = p.select(*keys, "n", "_mid", F.explode(F.array_compact(ends)).alias("_e")).select(*keys, "n", "_mid", "_e.*")
    top = F.length(F.bin(F.greatest(F.lit(2), F.call_function("div", F.col("n"), F.lit(4))))) - 1
    p = p.withColumn("scale", F.explode(F.transform(F.sequence(F.lit(0), top), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    share = [F.struct((F.col("at") - k * F.col("scale")).alias("place"), (sign * F.col("c")).alias("c")) for k, sign in ((0, -1), (1, 2), (2, -1))]
    s = p.withColumn("_s", F.explode(F.array(*share))).where((F.col("_s.place") >= 0) & (F.col("_s.place") <= F.col("n") - 2 * F.col("scale")))
    d = s.groupBy(*keys, "scale", F.col("_s.place").alias("place")).agg((F.sum("_s.c") / F.first("scale")).alias("d"), F.first("_mid").alias("_mid"))
    out = d.groupBy(*keys, "scale").agg(F.first("_mid").alias("_mid"), F.count("*").alias("n_coefficients"), (F.avg(F.col("d") * F.col("d")) / 2).alias("wavelet_power"))
    period = 2 * F.col("scale")
    frequency = F.when(F.col("_mid") > 0, 1 / (period * F.col("_mid")))
    return out.select(*keys, F.col("scale").alias("scale_beats"), frequency.alias("pseudo_frequency_hz"), period.alias("period_beats"), "n_coefficients", "wavelet_power")


def band_power(psd: DataFrame, keys, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(keys, band, low_hz, high_hz, n_scales, band_power): the power of the scales in each band, low end included; 0 where there is none."""
    rows = [F.struct(F.lit(n).alias("band"), F.lit(a).alias("low_hz"), F.lit(b).alias("high_hz")) for n, (a, b) in (bands or BANDS).items()]
    d = psd.withColumn("_b", F.explode(F.array(*rows))).select(*keys, "_b.*", "pseudo_frequency_hz", "wavelet_power")
    inside = (F.col("pseudo_frequency_hz") >= F.col("low_hz")) & (F.col("pseudo_frequency_hz") < F.col("high_hz"))
    return d.groupBy(*keys, "band", "low_hz", "high_hz").agg(F.count_if(inside).alias("n_scales"), F.coalesce(F.sum(F.when(inside, F.col("wavelet_power"))), F.lit(0.0)).alias("band_power"))


def denoise(df: DataFrame, keys, x: str, order, levels: int = 3, multiplier: float = 1.0, least: int = 8) -> DataFrame:
    """Adds ``denoised``, ``threshold``, ``levels_used`` and ``denoise_status``: what ``levels`` means of neighbours leave is shrunk by the threshold and put back.

    ``levels`` means of each value and the one before it are binomial weights over
    that many values back, the first value standing for those before it. The
    threshold is sqrt(2 ln n) robust SDs of the steps between rows. Missing values
    are bridged by rows for the steps and stay missing. Under ``least`` known
    values all of a group is NULL.
    """
    keys = list(keys)
    w, g = ordered(keys, order), whole(keys)
    v = finite(F.col(x).cast("double"))
    d = df.withColumn("_v", v).withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count("*").over(g)).withColumn("_k", F.count("_v").over(g))
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")))
    d = d.withColumn("_a", last_known(known, keys, order)).withColumn("_b", next_known(known, keys, order))
    a, b = F.col("_a"), F.col("_b")
    bridge = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_at") - a["at"], F.nullif(b["at"] - a["at"], F.lit(0)))
    d = d.withColumn("_z", F.coalesce("_v", bridge, a["v"], b["v"]))
    d = d.withColumn("_step", F.col("_z") - F.lag("_z").over(w))
    d = d.withColumn("_mid", median("_step").over(g)).withColumn("_sd", median(F.abs(F.col("_step") - F.col("_mid"))).over(g) / 0.6745)
    d = d.withColumn("threshold", F.when(F.col("_k") >= least, F.when(F.col("_sd") > 0, multiplier * F.col("_sd") * F.sqrt(2 * F.ln(F.col("_n").cast("double")))).otherwise(0.0)))
    first = F.first("_z").over(w)
    back = [F.col("_z"), *[F.coalesce(F.lag("_z", k).over(w), first) for k in range(1, levels + 1)]]
    deep = F.least(F.lit(levels), F.length(F.bin(F.greatest(F.lit(2), F.col("_n")))) - 1)
    smooth = None
    for used in range(levels, 0, -1):
        mean = sum(comb(used, k) * back[k] for k in range(used + 1)) / 2**used
        smooth = mean if smooth is None else F.when(deep == used, mean).otherwise(smooth)
    d = d.withColumn("_smooth", smooth)
    rest = F.col("_z") - F.col("_smooth")
    d = d.withColumn("denoised", F.when(F.col("_v").isNotNull(), F.col("_smooth") + F.signum(rest) * F.greatest(F.abs(rest) - F.col("threshold"), F.lit(0.0))))
    ok = F.col("_k") >= least
    d = d.withColumn("levels_used", F.when(ok, F.lit(levels))).withColumn("denoise_status", F.when(ok, "wavelet_denoised").otherwise("insufficient_finite_samples"))
    return d.withColumn("denoised", F.when(ok, F.col("denoised"))).drop("_v", "_at", "_n", "_k", "_a", "_b", "_z", "_step", "_mid", "_sd", "_smooth")
