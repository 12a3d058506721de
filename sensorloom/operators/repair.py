"""Pupil samples repaired with their flags, and quality of interval segments with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import last_known, median, next_known, ordered, quantile, reasons, whole
from ..functions.ranges import matched

FILLS = ("linear", "locf", "nocb", "constant")


def clean_pupil(df: DataFrame, keys, x: str, order, method: str = "linear", max_gap: int | None = None, spike: float = 6.0, spread_keys=()) -> DataFrame:
    """Adds ``clean``, ``was_invalid``, ``was_spike`` and ``was_imputed`` to each sample.

    Missing and non-positive samples are invalid. Those further than ``spike``
    scaled MADs from the median of the valid ones (over ``spread_keys``, by
    default the whole table; IQR / 1.349 where the MAD is 0, no spikes where both are) are
    spikes. Both are filled within each recording: ``linear`` by sample place,
    ``locf`` and ``nocb`` from the known sample before or after, ``constant`` by the
    recording's median; at the ends the nearest known sample is held. Runs of
    more than ``max_gap`` samples, and recordings without a known one, stay NULL.
    """
    if method not in FILLS:
        raise ValueError(f"method is one of {', '.join(FILLS)}")
    valid = F.coalesce(F.col(x) > 0, F.lit(False))
    d = df.withColumn("was_invalid", ~valid).withColumn("_g", F.when(valid, F.col(x).cast("double")))
    good, by = d.where("_g is not null").select(*spread_keys, "_g"), list(spread_keys)
    centre = good.groupBy(*by).agg(median("_g").alias("_m"), (quantile("_g", 0.75) - quantile("_g", 0.25)).alias("_q"))
    put = lambda a, b: matched(a, b, by, "left") if by else a.join(F.broadcast(b), how="left")  # noqa: E731  without keys: one row
    mad = put(good, centre).groupBy(*by).agg((1.4826 * median(F.abs(F.col("_g") - F.col("_m")))).alias("_s"))
    d = put(put(d, centre), mad).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.col("_q") / 1.349))
    d = d.withColumn("was_spike", F.coalesce((F.col("_s") > 0) & (F.abs(F.col(x) - F.col("_m")) > spike * F.col("_s")), F.lit(False)))
    d = d.withColumn("_w", F.when(~F.col("was_spike"), F.col("_g"))).withColumn("_rn", F.row_number().over(ordered(keys, order)))
    known = F.when(F.col("_w").isNotNull(), F.struct("_rn", "_w"))
    d = d.withColumn("_p", last_known(known, keys, order)).withColumn("_n", next_known(known, keys, order)).withColumn("_all", F.count("*").over(whole(keys)))
    before, after = F.col("_p._w"), F.col("_n._w")
    share = (F.col("_rn") - F.col("_p._rn")) / (F.col("_n._rn") - F.col("_p._rn"))
    fill = {"linear": F.coalesce(before + (after - before) * share, before, after), "locf": F.coalesce(before, after), "nocb": F.coalesce(after, before), "constant": median("_w").over(whole(keys))}[method]
    run = F.coalesce(F.col("_n._rn"), F.col("_all") + 1) - F.coalesce(F.col("_p._rn"), F.lit(0)) - 1
    filled = F.when(F.col("_w").isNotNull(), F.col("_w")).when(F.lit(True) if max_gap is None else run <= max_gap, fill)
    d = d.withColumn("clean", filled).withColumn("was_imputed", F.col("_w").isNull() & F.col("clean").isNotNull())
    return d.select(*df.columns, "clean", "was_invalid", "was_spike", "was_imputed")


def cleaning_summary(cleaned: DataFrame, keys) -> DataFrame:
    """Counts of invalid, spike, imputed and still missing samples."""
    return cleaned.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in (
        ("n_invalid_samples", F.col("was_invalid")), ("n_spike_samples", F.col("was_spike")), ("n_imputed_samples", F.col("was_imputed")), ("n_missing_after", F.col("clean").isNull()))])


def interval_segments(df: DataFrame, keys, rr: str, t: str, order, window: float | None = 60.0, min_beats: int = 20, min_duration: float = 20.0, low: float = 300.0, high: float = 2000.0,
                      max_artifacts: float = 0.2, max_change: float = 0.2) -> DataFrame:
    """Quality of segments of ``window`` seconds, counted from each recording's first time; ``rr`` in ms, ``t`` in s.

    A beat is implausible if missing or outside ``low`` to ``high``, and changes
    largely if it differs from the one before it in its segment by more than
    ``max_change`` of that. Either is an artifact. Beats without a time are left out. A
    segment of one beat lasts as long as its interval.
    """
    d = df.where(F.col(t).isNotNull()).withColumn("_start", F.min(t).over(whole(keys)))
    d = d.withColumn("segment_id", F.lit(1).cast("long") if window is None else F.floor((F.col(t) - F.col("_start")) / window).cast("long") + 1)
    was = F.lag(rr).over(ordered([*keys, "segment_id"], order))
    d = d.withColumn("_i", F.coalesce(~F.col(rr).between(low, high), F.lit(True))).withColumn("_c", F.coalesce(F.abs(F.col(rr) - was) / F.greatest(F.abs(was), F.lit(1.0)) > max_change, F.lit(False)))
    clean = F.when(~(F.col("_i") | F.col("_c")), F.col(rr))
    duration = F.when(F.count(t) > 1, F.max(t) - F.min(t)).otherwise(F.sum(rr) / 1000)
    s = d.groupBy(*keys, "segment_id").agg(
        F.min(t).alias("segment_start_s"), F.max(t).alias("segment_end_s"), duration.alias("duration_s"), F.count("*").alias("n_beats"), F.count(clean).alias("n_clean_beats"),
        (F.count_if(F.col("_i") | F.col("_c")) / F.count("*")).alias("artifact_prop"), F.avg(clean).alias("mean_rr_ms"), median(clean).alias("median_rr_ms"), F.min(rr).alias("min_rr_ms"), F.max(rr).alias("max_rr_ms"),
        F.count_if("_i").alias("n_implausible_rr"), F.count_if("_c").alias("n_large_successive_changes"))
    why = reasons(("too_few_clean_beats", F.col("n_clean_beats") < min_beats), ("duration_too_short", F.coalesce(F.col("duration_s") < min_duration, F.lit(True))), ("high_artifact_prop", F.col("artifact_prop") > max_artifacts),
                  ("implausible_rr", F.col("n_implausible_rr") > 0), ("large_successive_change", F.col("n_large_successive_changes") > 0))
    return s.withColumn("quality_ok", why == "").withColumn("reasons", F.when(why == "", "ok").otherwise(why))
