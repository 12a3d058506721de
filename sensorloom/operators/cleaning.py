"""Local detrending of heart-beat intervals, and artifact handling of skin conductance by intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import boundaries, covering, home, in_blocks, merged, near, within
from ..functions.core import finite, reasons
from ..functions.ranges import matched, running

#: Rows of a block, and windows in a block of time.
ROWS, WINDOWS = 4096, 64


def detrend_intervals(df: DataFrame, keys, x: str, order, t: str | None = None, seconds: float = 60.0, method: str = "median") -> DataFrame:
    """(keys, order, time_s, rri_ms, trend_ms, rri_detrended_ms) of the positive intervals.

    The trend is the median, mean or local line of all intervals within half of
    ``seconds`` before and after; the time is ``t``, or the sum of the intervals
    themselves. A line takes three intervals at two times, else the mean stands.
    Groups under three intervals have no trend. Blocks of time run side by side.
    """
    keys = list(keys)
    v = finite(F.col(x).cast("double"))
    d = df.select(*keys, *order, v.alias("rri_ms"), *([F.col(t).cast("double").alias("time_s")] if t and t not in (*keys, *order) else [])).where("rri_ms > 0")
    d = running(d, keys, order, s=F.col("rri_ms"), k=F.lit(1).cast("long"))
    d = d.withColumn("time_s", F.col(t).cast("double") if t in order else (F.col("s_before") + F.col("rri_ms")) / 1000 if t is None else F.col("time_s"))
    b = in_blocks(d, "time_s", WINDOWS * seconds, seconds / 2)
    over = lambda value: within(value, keys, "time_s", seconds / 2)
    mean = over("avg(rri_ms)")
    if method == "median":
        trend = over("percentile(rri_ms, 0.5)")
    elif method == "mean":
        trend = mean
    elif method == "linear":
        line = over("regr_slope(rri_ms, time_s)") * F.col("time_s") + over("regr_intercept(rri_ms, time_s)")
        trend = F.when(over("count(*)") >= 3, F.coalesce(line, mean)).otherwise(mean)
    else:
        raise ValueError("method is median, mean or linear")
    out = home(b.withColumn("trend_ms", trend)).withColumn("trend_ms", F.when(F.col("k_total") >= 3, F.col("trend_ms")))
    out = matched(out, out.groupBy(*keys).agg(F.avg("trend_ms").alias("_level")), keys)
    return out.select(*keys, *order, *(["time_s"] if "time_s" not in order else []), "rri_ms", "trend_ms", (F.col("rri_ms") - F.col("trend_ms") + F.col("_level")).alias("rri_detrended_ms"))


def _samples(seconds: float, rate: float, least: int) -> int:
    return max(least, round(seconds * rate))


def clean_conductance(df: DataFrame, keys, x: str, t: str, order, rate: float, valid: tuple[float, float] = (0.0, 50.0), slope: float = 10.0, same: float = 1e-5, clip_s: float = 0.5, island_s: float = 1.0, epoch_s: float = 0.25, smooth_s: float = 0.25, width: int = ROWS) -> DataFrame:
    """``df`` with scr_raw, artifact, artifact_reason, scr_clean and scr_processed.

    Samples out of range or missing, steps steeper than ``slope`` a second and flat
    runs of ``clip_s`` are bad. Valid stretches shorter than ``island_s`` between
    them go too, and all is widened by ``epoch_s``: the widening and joining work
    on intervals, of which there are few, not on samples. Artifacts are bridged by
    the samples beside them (the nearest at an open end), then a centred mean of
    ``smooth_s`` follows where it is whole. ``rate`` is the sampling rate in Hz.
    A group without any good sample has NULLs.
    """
    keys = list(keys)
    flat_n, island_n, epoch_n, n = _samples(clip_s, rate, 2), _samples(island_s, rate, 1), _samples(epoch_s, rate, 0), _samples(smooth_s, rate, 1)
    d = running(df.withColumn("scr_raw", finite(F.col(x).cast("double"))), keys, order, _i=F.lit(1).cast("long")).withColumnsRenamed({"_i_before": "_i", "_i_total": "_n"})
    b, w = in_blocks(d, "_i", width, 1), near(keys, "_i", -1, -1)
    step, dt = F.col("scr_raw") - F.first("scr_raw").over(w), F.col(t) - F.first(t).over(w)
    b = home(b.withColumn("_step", F.abs(step)).withColumn("_dt", dt))
    bad, steep = F.col("scr_raw").isNull() | ~F.col("scr_raw").between(*valid), F.coalesce(F.try_divide("_step", "_dt") > slope, F.lit(False))
    b = b.withColumn("_range", bad).withColumn("_slope", steep).withColumn("_flat", F.coalesce(F.col("_step") <= same, F.lit(False)))
    clipped = boundaries(b, keys, "_i", F.col("_flat"), width).where(F.col("hi") - F.col("lo") + 1 >= flat_n)
    first = merged(boundaries(b, keys, "_i", F.col("_range") | F.col("_slope"), width).unionByName(clipped), keys)
    size = d.groupBy(*keys).agg(F.max("_n").alias("_n"))
    # sentinels on both sides, so that the stretches before the first and after the last bad sample are gaps like the others
    edge = size.select(*keys, F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")), F.struct(F.col("_n").alias("lo"), F.col("_n").alias("hi")))).alias("e")).select(*keys, "e.*")
    gaps = first.unionByName(edge).withColumn("_next", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo")))
    island = gaps.select(*keys, (F.col("hi") + 1).alias("lo"), (F.col("_next") - 1).alias("hi")).where("lo <= hi").where(F.col("hi") - F.col("lo") + 1 < (island_n if island_n > 1 else 0))
    wide = matched(first.unionByName(island), size, keys).select(*keys, F.greatest(F.col("lo") - epoch_n, F.lit(0)).alias("lo"), F.least(F.col("hi") + epoch_n, F.col("_n") - 1).alias("hi"))
    art = merged(wide, keys)
    side = b.select(*keys, F.col("_i").alias("_at"), F.col("scr_raw").alias("_v"))
    for name, at in (("_a", F.col("lo") - 1), ("_b", F.col("hi") + 1)):
        art = matched(art.withColumn("_at", at), side.withColumnRenamed("_v", name), [*keys, "_at"], "left").drop("_at")
    r = covering(b, keys, "_i", {"_clip": clipped, "_island": island, "_art": art}, width)
    told = reasons(("range_or_nonfinite", F.col("_range")), ("slope", F.col("_slope")), ("clipping", F.col("_clip").isNotNull()), ("short_valid_island", F.col("_island").isNotNull()))
    a, z = F.col("_art._a"), F.col("_art._b")
    span = (F.col("_art.hi") - F.col("_art.lo") + 2).cast("double")
    bridge = F.coalesce(a + (z - a) * (F.col("_i") - F.col("_art.lo") + 1) / span, a, z)
    artifact = F.col("_art").isNotNull()
    r = r.withColumn("artifact", artifact).withColumn("artifact_reason", F.when(told != "", told).when(artifact, "artifact_epoch").otherwise("accepted")).withColumn("scr_clean", F.when(artifact, bridge).otherwise(F.col("scr_raw")))
    after = (n - 1) // 2
    c, w = in_blocks(r, "_i", width, n), near(keys, "_i", after - (n - 1), after)
    full = F.count("scr_clean").over(w) == n
    out = home(c.withColumn("scr_processed", F.when(full, F.avg("scr_clean").over(w)).otherwise(F.col("scr_clean"))))
    return out.select(*df.columns, "scr_raw", "artifact", "artifact_reason", "scr_clean", "scr_processed")


def artifact_epochs(cleaned: DataFrame, keys, t: str, order) -> DataFrame:
    """(keys, lo, hi, start_s, end_s, duration_s): each run of artifact samples of ``clean_conductance``, places from 0."""
    keys = list(keys)
    d = running(cleaned.select(*keys, *order, *([t] if t not in order else []), "artifact"), keys, order, _i=F.lit(1).cast("long"))
    i = boundaries(d, keys, "_i_before", F.col("artifact"), ROWS)
    at = d.select(*keys, F.col("_i_before").alias("lo"), F.col(t).alias("start_s"))
    i = matched(matched(i, at, [*keys, "lo"]), at.withColumnsRenamed({"lo": "hi", "start_s": "end_s"}), [*keys, "hi"])
    return i.withColumn("duration_s", F.col("end_s") - F.col("start_s"))
