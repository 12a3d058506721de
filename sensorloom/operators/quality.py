"""Flags, artifact and dropout detection, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import correlation, islands, median, ordered, quantile, reasons, robust, whole


def dropouts(df: DataFrame, keys, x: str, order, missing_run: int, flat_run: int, tolerance: float = 0.0) -> DataFrame:
    """Flags missing runs and runs of samples that each stay within ``tolerance`` of the last."""
    d = islands(df, F.col(x).isNull(), keys, order)
    n = F.count("*").over(whole([*keys, "run"]))
    d = d.withColumn("missing_dropout", F.col(x).isNull() & (n >= missing_run)).drop("run")
    step = F.abs(F.col(x) - F.lag(x).over(ordered(keys, order)))
    d = d.withColumn("_flat", F.coalesce(step <= tolerance, F.lit(False)))
    d = islands(d, F.col("_flat"), keys, order)
    m = F.count("*").over(whole([*keys, "run"]))
    return d.withColumn("flat_dropout", F.col("_flat") & (m >= flat_run)).drop("run", "_flat")


def nonwear(df: DataFrame, keys, x: str, t: str, order, least: int) -> DataFrame:
    """Intervals of missing, zero or constant samples of at least ``least`` rows."""
    kind = F.when(F.col(x).isNull(), "missing").when(F.col(x) == 0, "zero").when(F.col(x) == F.lag(x).over(ordered(keys, order)), "constant").otherwise("worn")
    d = islands(df.withColumn("kind", kind), F.col("kind"), keys, order)
    runs = d.groupBy(*keys, "run", "kind").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("stop"))
    return runs.where((F.col("kind") != "worn") & (F.col("n") >= least)).drop("run")


def signal_activity(df: DataFrame, keys, x: str, low_sd: float) -> DataFrame:
    n, s = F.count(x), F.stddev_samp(x)
    status = F.when(n == 0, "missing").when(F.max(F.abs(x)) == 0, "all_zero").when(F.min(x) == F.max(x), "constant").when(s < low_sd, "low_variation").otherwise("active")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), n.alias("n_valid"), s.alias("sd"), status.alias("status"))


def missingness(df: DataFrame, columns) -> DataFrame:
    """One row a column: missing and zero counts and shares, extremes; one pass over the table."""
    n = F.count("*")
    one = df.agg(n.alias("n"), *[f.alias(f"{k}_{c}") for c in columns for k, f in (
        ("missing", F.count_if(F.col(c).isNull())), ("zero", F.count_if(F.col(c) == 0)), ("min", F.min(c).cast("double")), ("max", F.max(c).cast("double")))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col("missing_" + c).alias("n_missing"), F.col("zero_" + c).alias("n_zero"), F.col("min_" + c).alias("min"), F.col("max_" + c).alias("max")) for c in columns]))
    return one.select(rows.alias("r")).select("r.*").withColumn("missing_pct", 100 * F.col("n_missing") / F.col("n_rows"))


def channel_audit(df: DataFrame, keys, x: str, order, low: float, high: float, jump: float) -> DataFrame:
    """Range, jumps and flat steps over usable samples, jumps between neighbours after filtering."""
    u = df.where(F.col(x).isNotNull() & (F.col(x) != 0))
    step = F.abs(F.col(x) - F.lag(x).over(ordered(keys, order)))
    return u.withColumn("step", step).groupBy(*keys).agg(
        F.count("*").alias("usable"), F.count_if(~F.col(x).between(low, high)).alias("out_of_range"), F.count_if(F.col("step") > jump).alias("jumps"),
        F.count_if(F.col("step") == 0).alias("flat_steps"), F.min(x).alias("min"), F.max(x).alias("max"))


def to_conductance(x: Column, unit: str) -> Column:
    """Resistance in ohm or kohm to microsiemens; non-positive values are missing."""
    return {"ohm": F.when(x > 0, 1e6 / x), "kohm": F.when(x > 0, 1e3 / x), "us": F.when(x > 0, x)}[unit]


def eda_artifacts(df: DataFrame, keys, x: str, t: str, order, low: float, high: float, slope: float, k: float = 8.0) -> DataFrame:
    """Missing, negative, out of bounds, steep and robust-jump samples with their reasons."""
    w = ordered(keys, order)
    d = df.withColumn("step", F.col(x) - F.lag(x).over(w)).withColumn("slope", F.try_divide(F.col("step"), F.col(t) - F.lag(t).over(w)))
    d = robust(d, keys, "step", "_c", "_s")
    why = reasons(
        ("missing", F.col(x).isNull()), ("negative", F.col(x) < 0), ("bounds", ~F.col(x).between(low, high)), ("slope", F.abs("slope") > slope),
        ("jump", (F.col("_s") > 0) & (F.abs(F.col("step") - F.col("_c")) > k * F.col("_s"))))
    return d.withColumn("reasons", why).withColumn("artifact", F.col("reasons") != "").drop("_c", "_s")


def rr_outliers(df: DataFrame, keys, x: str, low: float, high: float, k: float) -> DataFrame:
    """Range and MAD outliers; the IQR stands in where the MAD is 0."""
    w = whole(keys)
    d = robust(df.withColumn("_i", (quantile(x, 0.75).over(w) - quantile(x, 0.25).over(w)) / 1.349), keys, x, "_c", "_m")
    scale = F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.col("_i"))
    d = d.withColumn("out_of_range", ~F.col(x).between(low, high))
    return d.withColumn("outlier", F.coalesce((scale > 0) & (F.abs(F.col(x) - F.col("_c")) > k * scale), F.lit(False))).drop("_c", "_i", "_m")


def ibi_quality(df: DataFrame, keys, x: str, order, low: float, high: float, jump: float) -> DataFrame:
    """First matching status of each interval: missing, nonpositive, range, jump or ok."""
    last = F.lag(x).over(ordered(keys, order))
    status = F.when(F.col(x).isNull(), "missing").when(F.col(x) <= 0, "nonpositive").when(~F.col(x).between(low, high), "range").when(F.abs(F.col(x) - last) > jump, "jump").otherwise("ok")
    return df.withColumn("status", status)


def ibi_implausible(df: DataFrame, keys, x: str, order, low: float, high: float, relative: float) -> DataFrame:
    d = df.withColumn("was", F.lag(x).over(ordered(keys, order)))
    bad = ~F.col(x).between(low, high) | F.coalesce(F.abs(F.col(x) - F.col("was")) / F.when(F.col("was") > 0, F.col("was")) > relative, F.lit(False))
    return d.withColumn("implausible", F.coalesce(bad, F.lit(True))).withColumn("clean", F.when(~F.col("implausible"), F.col(x))).drop("was")


def hr_ibi_consistency(df: DataFrame, keys, hr: str, ibi_ms: str, tolerance: float) -> DataFrame:
    d = df.withColumn("d", F.abs(F.col(hr) - 60000.0 / F.when(F.col(ibi_ms) > 0, F.col(ibi_ms))))
    return d.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.max("d").alias("max_diff"), (F.count_if(F.col("d") <= tolerance) / F.count("d")).alias("agree"))


def local_correction(df: DataFrame, keys, x: str, order, half: int, relative: float) -> DataFrame:
    """Samples far from the median around them take it."""
    m = median(x).over(ordered(keys, order, -half, half))
    d = df.withColumn("local", m).withColumn("artifact", F.coalesce(F.abs(F.col(x) - F.col("local")) > relative * F.col("local"), F.lit(False)))
    return d.withColumn("corrected", F.when(F.col("artifact"), F.col("local")).otherwise(F.col(x)))


def blinks(df: DataFrame, keys, x: str, t: str, order, least: float = 0.0) -> DataFrame:
    """Runs of missing or non-positive pupil samples as intervals."""
    d = islands(df, F.coalesce(F.col(x) <= 0, F.lit(True)), keys, order)
    r = d.groupBy(*keys, "run").agg(F.first(F.coalesce(F.col(x) <= 0, F.lit(True))).alias("blink"), F.min(t).alias("onset"), F.max(t).alias("offset"), F.count("*").alias("n"))
    return r.where("blink").withColumn("duration", F.col("offset") - F.col("onset")).where(F.col("duration") >= least).drop("blink", "run")


def dilated(df: DataFrame, keys, flag: str, order, before: int, after: int) -> DataFrame:
    """The flag spread over neighbouring rows."""
    return df.withColumn("dilated", F.max(F.col(flag).cast("int")).over(ordered(keys, order, -after, before)) == 1)


def gaze_filter(df: DataFrame, keys, x: str, y: str, t: str, order, box, speed: float) -> DataFrame:
    """Bounds and velocity flags with reasons, masked coordinates."""
    w = ordered(keys, order)
    v = F.try_divide(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.col(t) - F.lag(t).over(w))
    x0, y0, x1, y1 = box
    d = df.withColumn("velocity", v)
    d = d.withColumn("reasons", reasons(("missing", F.col(x).isNull() | F.col(y).isNull()), ("bounds", ~(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))), ("velocity", F.col("velocity") > speed)))
    return d.withColumn("gaze_x", F.when(F.col("reasons") == "", F.col(x))).withColumn("gaze_y", F.when(F.col("reasons") == "", F.col(y)))


def sampling(df: DataFrame, keys, t: str, order, gap_factor: float = 1.5) -> DataFrame:
    """Median interval, jitter, repeats, backward steps, gaps and estimated lost samples."""
    d = df.withColumn("dt", F.col(t) - F.lag(t).over(ordered(keys, order)))
    step = d.groupBy(*keys).agg(median(F.when(F.col("dt") > 0, F.col("dt"))).alias("step"))
    d = d.join(step, keys)
    gap = F.col("dt") > gap_factor * F.col("step")
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("step").alias("step"), F.stddev_samp(F.when(F.col("dt") > 0, F.col("dt"))).alias("jitter"), F.count_if(F.col("dt") == 0).alias("repeats"),
        F.count_if(F.col("dt") < 0).alias("backward"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.round(F.col("dt") / F.col("step")) - 1)), F.lit(0.0)).cast("long").alias("lost"))


def classify(df: DataFrame, rules: dict[str, Column], exclude_at: int = 2) -> DataFrame:
    """pass, review or exclude_candidate by the number of failed rules, with their names."""
    n = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in rules.values()), F.lit(0))
    return df.withColumn("failed", n).withColumn("class", F.when(n == 0, "pass").when(n < exclude_at, "review").otherwise("exclude_candidate")).withColumn("why", reasons(*rules.items(), sep="|"))


def response_pattern(df: DataFrame, keys, x: str, low: float, high: float) -> DataFrame:
    m = F.avg(F.abs(x))
    return df.groupBy(*keys).agg(F.count(x).alias("n"), m.alias("mean_abs"), F.max(F.abs(x)).alias("max_abs"), F.when(m < low, "hypo").when(m > high, "hyper").otherwise("typical").alias("pattern"))


def nonresponders(df: DataFrame, unit: str, response: Column, least: float) -> DataFrame:
    return df.groupBy(unit).agg(F.count("*").alias("trials"), F.count_if(response).alias("responses")).withColumn("rate", F.col("responses") / F.col("trials")).withColumn("nonresponder", F.col("rate") < least)


def psi_drift(reference: DataFrame, sessions: DataFrame, session: str, x: str, bins: int = 10) -> DataFrame:
    """Population stability index of each session against the reference's quantile bins."""
    edges = reference.agg(F.percentile(x, F.lit([k / bins for k in range(1, bins)])).alias("edges"))  # one row
    place = F.size(F.filter("edges", lambda e: e < F.col(x)))
    cut = lambda d, *keys: d.where(F.col(x).isNotNull()).join(F.broadcast(edges)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    share = lambda n, total: F.greatest(n / total, F.lit(1e-6))
    ref = cut(reference).withColumn("p", share(F.col("n"), F.sum("n").over(whole([])))).select("bin", "p")
    got = cut(sessions, session)
    got = got.withColumn("q", share(F.col("n"), F.sum("n").over(whole([session])))).select(session, "bin", "q")
    cells = sessions.select(session).distinct().crossJoin(F.broadcast(ref))  # at most ``bins`` rows a session
    d = cells.join(got, [session, "bin"], "left").withColumn("q", F.coalesce("q", F.lit(1e-6)))
    return d.groupBy(session).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def session_comparability(df: DataFrame, unit: str, metrics) -> DataFrame:
    """Unit means of each metric with z scores and IQR outlier flags across units."""
    m = df.groupBy(unit).agg(*[F.avg(c).alias(c) for c in metrics]).unpivot([unit], list(metrics), "metric", "mean")
    c = m.groupBy("metric").agg(F.avg("mean").alias("_m"), F.stddev_samp("mean").alias("_s"), quantile("mean", 0.25).alias("_a"), quantile("mean", 0.75).alias("_b"))
    out = m.join(F.broadcast(c), "metric")  # one row a metric
    fence = 1.5 * (F.col("_b") - F.col("_a"))
    return out.select(unit, "metric", "mean", F.try_divide(F.col("mean") - F.col("_m"), F.col("_s")).alias("z"), (~F.col("mean").between(F.col("_a") - fence, F.col("_b") + fence)).alias("outlier"))


def experiment_design(df: DataFrame, factors) -> DataFrame:
    """Rows of every combination of factor levels and its margins."""
    return df.cube(*factors).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def event_coverage(df: DataFrame, unit: str, event: str, expected: DataFrame) -> DataFrame:
    """Expected events that a unit lacks."""
    want = df.select(unit).distinct().crossJoin(expected)  # units by the design's expected events
    return want.join(df.select(unit, event).distinct(), [unit, event], "left_anti")


def condition_balance(df: DataFrame, unit: str, condition: str) -> DataFrame:
    n = df.groupBy(unit, condition).agg(F.count("*").alias("n"))
    return n.groupBy(unit).agg(F.count("*").alias("conditions"), F.min("n").alias("least"), F.max("n").alias("most"), (F.max("n") / F.min("n")).alias("imbalance"))


def group_correlation(df: DataFrame, keys, x: str, y: str, limit: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.when(F.col(x).isNotNull(), F.col(y))).alias("n"), correlation(x, y).alias("r")).withColumn("flagged", F.coalesce(F.abs("r") > limit, F.lit(False)))


def step_artifacts(df: DataFrame, keys, x: str, order, k: float) -> DataFrame:
    """Steps beyond k scaled MADs of the group's steps, and repeated values."""
    d = df.withColumn("step", F.col(x) - F.lag(x).over(ordered(keys, order)))
    d = robust(d, keys, "step", "_c", "_s").withColumn("needle", (F.col("_s") > 0) & (F.abs(F.col("step") - F.col("_c")) > k * F.col("_s")))
    return d.withColumn("flat", F.coalesce(F.col("step") == 0, F.lit(False))).drop("_c", "_s")


def mad_artifacts(df: DataFrame, keys, x: str, order, k: float = 8.0, flat_tolerance: float = 1e-6, flat_run: int = 5, wall: float | None = None) -> DataFrame:
    """Adds ``mad_artifact`` and ``mad_artifact_type`` of each sample: none, flatline, wall or, for several kinds at once, multiple.

    A needle is a step (from the sample before) further than ``k`` scaled MADs
    from the group's median step, and such a step counts as both needle and step, hence
    as multiple. A flat line is ``flat_run`` or more samples in a row that move by no more than
    ``flat_tolerance``; a wall is a step larger than ``wall``. The first sample and
    steps from or to a missing one are of no kind, and end a flat line.
    """
    d = df.withColumn("_step", F.col(x) - F.lag(x).over(ordered(keys, order)))
    d = robust(d, keys, "_step", "_c", "_s")
    still = F.coalesce(F.abs("_step") <= flat_tolerance, F.lit(False))
    d = islands(d.withColumn("_still", still), F.col("_still"), keys, order, "_run")
    needle = F.coalesce((F.col("_s") > 0) & (F.abs(F.col("_step") - F.col("_c")) > k * F.col("_s")), F.lit(False))
    flat = F.col("_still") & (F.count("*").over(whole([*keys, "_run"])) >= flat_run)
    over = F.lit(False) if wall is None else F.coalesce(F.abs("_step") > wall, F.lit(False))
    d = d.withColumns({"_needle": needle, "_flat": flat, "_wall": over})
    kind = F.when(F.col("_needle") | (F.col("_flat") & F.col("_wall")), "multiple").when(F.col("_flat"), "flatline").when(F.col("_wall"), "wall").otherwise("none")
    return d.withColumn("mad_artifact", kind != "none").withColumn("mad_artifact_type", kind).drop("_step", "_c", "_s", "_still", "_run", "_needle", "_flat", "_wall")


def rate_artifacts(df: DataFrame, keys, x: str, order, low: float, high: float, percent: float, pad: int) -> DataFrame:
    """Out of range or changing by more than ``percent``, spread over ``pad`` rows on each side."""
    was = F.lag(x).over(ordered(keys, order))
    d = df.withColumn("bad", ~F.col(x).between(low, high) | F.coalesce(F.try_divide(100 * F.abs(F.col(x) - was), was) > percent, F.lit(False)))
    return d.withColumn("padded", F.max("bad").over(ordered(keys, order, -pad, pad)))


def beat_audit(df: DataFrame, keys, x: str, t: str, order, low: float, high: float, change: float) -> DataFrame:
    w = ordered(keys, order)
    was = F.lag(x).over(w)
    d = df.withColumn("_d", F.try_divide(F.abs(F.col(x) - was), was)).withColumn("_t", F.lag(t).over(w))
    return d.withColumn("reasons", reasons(("range", ~F.col(x).between(low, high)), ("duplicate", F.col(t) == F.col("_t")), ("abrupt", F.col("_d") > change))).drop("_d", "_t")


def gaze_checks(df: DataFrame, keys, x: str, t: str, order, low: float, high: float) -> DataFrame:
    """Missing, repeated, backward and out-of-bounds samples of each recording."""
    d = df.withColumn("dt", F.col(t) - F.lag(t).over(ordered(keys, order)))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(x).isNull()).alias("missing"), F.count_if(F.col("dt") == 0).alias("duplicates"), F.count_if(F.col("dt") < 0).alias("backward"),
        F.count_if(~F.col(x).between(low, high)).alias("outside"), ((F.count_if(F.col(x).isNull()) == 0) & (F.count_if(F.col("dt") <= 0) == 0)).alias("passed"))
