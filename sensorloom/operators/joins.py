"""Joins, alignment and synchronisation of streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.core import correlation, last_known, median, next_known, ordered, whole

MOST_AREAS = 10_000


def sync(left: DataFrame, right: DataFrame, by, keep, how: str = "left") -> DataFrame:
    """Exact join on ``by`` where NULL keys match; only ``keep`` comes from the right."""
    r = right.select(*[F.col(c).alias("_r_" + c) for c in by], *keep)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_r_" + c)) for c in by])
    return left.join(r, on, how).drop(*["_r_" + c for c in by])


def change_events(df: DataFrame, keys, marker: str, order, initial: bool = True) -> DataFrame:
    """Rows where the marker differs from the last valid one, with that one and the event's number."""
    d = df.where(F.col(marker).isNotNull()).withColumn("previous", F.lag(marker).over(ordered(keys, order)))
    first = F.row_number().over(ordered(keys, order)) == 1
    d = d.withColumn("_first", first).where(F.when(F.col("_first"), F.lit(initial)).otherwise(F.col(marker) != F.col("previous")))
    return d.withColumn("event_order", F.row_number().over(ordered(keys, order)).cast("long")).drop("_first")


def _near(events: DataFrame, samples: DataFrame, keys, et: str, t: str, before: float, after: float, how: str = "inner") -> DataFrame:
    """Samples within [-before, +after] of each event of the same group.

    Both sides carry a time bucket as wide as the window, so the join is an equi
    join on (keys, bucket): no group's events meet all of the group's samples.
    """
    width = before + after
    e = events.withColumn("_b", F.explode(F.sequence(F.floor((F.col(et) - before) / width), F.floor((F.col(et) + after) / width))))
    s = samples.select(*[F.col(k).alias("_s_" + k) for k in keys], *[c for c in samples.columns if c not in keys], F.floor(F.col(t) / width).alias("_sb"))
    on = [F.col(k).eqNullSafe(F.col("_s_" + k)) for k in keys] + [F.col("_b") == F.col("_sb"), F.col(t).between(F.col(et) - before, F.col(et) + after)]
    return e.join(s, reduce(lambda a, b: a & b, on), how).drop("_b", "_sb", *["_s_" + k for k in keys])


def align_to_events(events: DataFrame, samples: DataFrame, keys, et: str, t: str, before: float, after: float) -> DataFrame:
    """Samples around each event with their relative time; a sample near two events appears twice."""
    return _near(events, samples, keys, et, t, before, after).withColumn("rel", F.col(t) - F.col(et))


def event_windows(events: DataFrame, samples: DataFrame, keys, event: str, et: str, t: str, x: str, before: float, after: float) -> DataFrame:
    """Per event: mean, sd, extremes and missing count of the samples around it; events without samples have n 0."""
    a = align_to_events(events, samples, keys, et, t, before, after).groupBy(event).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(F.col(x).isNull()).alias("n_missing"))
    return events.select(event).join(a, event, "left").fillna(0, ["n", "n_missing"])


def event_locked(events: DataFrame, samples: DataFrame, keys, event: str, et: str, t: str, x: str, before: float, after: float) -> DataFrame:
    """Baseline mean over [-before, 0), peak, its latency and the trapezoid area over [0, after] of the baseline-corrected signal."""
    a = align_to_events(events, samples, keys, et, t, before, after)
    base = F.avg(F.when(F.col("rel") < 0, F.col(x))).over(whole([event]))
    a = a.withColumn("base", base).where(F.col("rel") >= 0).withColumn("y", F.col(x) - F.coalesce("base", F.lit(0.0)))
    w = ordered([event], ["rel", x])
    a = a.withColumn("_t", F.lead("rel").over(w)).withColumn("_y", F.lead("y").over(w))
    return a.groupBy(event).agg(
        F.first("base").alias("baseline"), F.max("y").alias("peak"), F.max_by("rel", F.struct(F.col("y"), -F.col("rel"))).alias("latency"),
        F.sum((F.col("y") + F.col("_y")) / 2 * (F.col("_t") - F.col("rel"))).alias("area"), F.count("y").alias("n"))


def clock_fit(pairs: DataFrame, keys, reference: str, target: str) -> DataFrame:
    """Slope and intercept that map target times to the reference clock, residual sd and median offset."""
    fit = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(reference, target).alias("slope"), F.regr_intercept(reference, target).alias("intercept"), median(F.col(reference) - F.col(target)).alias("offset"))
    r = F.col(reference) - F.col("intercept") - F.col("slope") * F.col(target)
    res = pairs.join(fit, keys).groupBy(*keys).agg(F.stddev_samp(r).alias("residual_sd"))
    return fit.join(res, keys)


def nearest(left: DataFrame, right: DataFrame, keys, t: str, order: str, x: str, tolerance: float) -> DataFrame:
    """Each left row with the nearest right sample in time within the tolerance, the earlier one on ties.

    One union and two running windows instead of a theta join.
    """
    a = left.select(*keys, F.col(t).alias("t"), F.col(order).alias("_o"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("x"))
    b = right.select(*keys, F.col(t).alias("t"), F.col(order).alias("_o"), F.lit(0).alias("side"), F.col(x).cast("double").alias("x"))
    at = F.when(F.col("side") == 0, F.struct("t", "x"))
    u = a.union(b)
    u = u.withColumn("p", last_known(at, keys, ["t", "side", "_o"])).withColumn("n", next_known(at, keys, ["t", "side", "_o"])).where("side = 1")
    dp, dn = F.col("t") - F.col("p")["t"], F.col("n")["t"] - F.col("t")
    use = F.when(dn.isNull() | (dp <= dn), F.col("p")).otherwise(F.col("n"))
    d = u.withColumn("m", use)
    ok = F.abs(F.col("m")["t"] - F.col("t")) <= tolerance
    return d.select(*keys, F.col("_o").alias(order), "t", F.when(ok, F.col("m")["t"]).alias("match_t"), F.when(ok, F.col("m")["x"]).alias("match_x"))


def lag_correlations(df: DataFrame, keys, pairs, order, most: int, least: int = 5) -> DataFrame:
    """(keys, signal_1, signal_2, best_lag, best_r): the lag of -most..most samples of the largest correlation, the smaller lag on ties.

    The first signal at a row meets the second ``lag`` rows after it. One window
    puts the shifted samples beside each row and one aggregation correlates all
    of them, so samples are shuffled once, whatever the number of pairs and lags.
    Pairs of fewer than ``least`` complete rows at every lag have no row.
    """
    w, lags = ordered(keys, order), range(-most, most + 1)
    later = {(b, k): f"_{n}_{k + most}" for n, b in enumerate(dict.fromkeys(b for _, b in pairs)) for k in lags}
    d = df.select(*keys, *dict.fromkeys(a for a, _ in pairs), *[F.lead(b, k).over(w).alias(name) for (b, k), name in later.items()])
    each = [(a, b, k, F.col(a), F.col(later[b, k])) for a, b in pairs for k in lags]
    sums = [e.alias(f"_{c}{n}") for n, (_, _, _, x, y) in enumerate(each) for c, e in (("n", F.count(F.when(x.isNotNull(), y))), ("r", correlation(x, y)))]
    rows = F.array(*[F.struct(F.lit(a).alias("signal_1"), F.lit(b).alias("signal_2"), F.lit(k).alias("lag"), F.col(f"_n{n}").alias("n"), F.col(f"_r{n}").alias("r")) for n, (a, b, k, _, _) in enumerate(each)])
    r = d.groupBy(*keys).agg(*sums).select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*").where(F.col("n") >= least)
    found = F.col("r").isNotNull()
    best = F.max_by(F.when(found, F.col("lag")), F.when(found, F.struct(F.round(F.abs("r"), 9), -F.abs("lag"), "lag")))
    return r.groupBy(*keys, "signal_1", "signal_2").agg(best.alias("best_lag"), F.max(F.abs("r")).alias("best_r"))


def lag_correlation(df: DataFrame, keys, x: str, y: str, order, most: int, least: int = 5) -> DataFrame:
    """(keys, best_lag, best_r) of x with y shifted by each lag of -most..most samples."""
    return lag_correlations(df, keys, [(x, y)], order, most, least).drop("signal_1", "signal_2")


def rank_correlation(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (mean ranks on ties) of the complete pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c):
        return F.rank().over(ordered(keys, [c])) + (F.count("*").over(whole([*keys, c])) - 1) / 2

    d = d.withColumn("_rx", rank(x)).withColumn("_ry", rank(y))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), correlation(x, y).alias("pearson"), correlation("_rx", "_ry").alias("spearman"))


def sync_drift(pairs: DataFrame, keys, reference: str, target: str, tolerance: float) -> DataFrame:
    """Lag of target behind reference: its drift by time, spread, and whether the range stays within tolerance."""
    d = pairs.withColumn("lag", F.col(target) - F.col(reference))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("lag", reference).alias("drift"), F.stddev_samp("lag").alias("sd"), (F.max("lag") - F.min("lag")).alias("range")).withColumn("ok", F.col("range") <= tolerance)


def assign_area(points: DataFrame, areas: DataFrame, x: str, y: str) -> DataFrame:
    """Each point with the rectangle of highest priority (then smallest, then by name) that holds it, bounds included; equal points stay apart.

    A stimulus' areas become one array in the order of choice, so points are neither joined nor shuffled; ``MOST_AREAS`` bounds it.
    """
    if areas.limit(MOST_AREAS + 1).count() > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas: part the points by stimulus")
    size = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    listed = areas.agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), size.alias("s"), "aoi", "xmin", "xmax", "ymin", "ymax"))).alias("_areas"))
    inside = lambda a: F.col(x).between(a["xmin"], a["xmax"]) & F.col(y).between(a["ymin"], a["ymax"])
    hit = points.join(F.broadcast(listed)).withColumn("_hit", F.filter("_areas", inside))
    return hit.withColumn("area", F.get("_hit", F.lit(0))["aoi"]).withColumn("n_areas", F.size("_hit").cast("long")).drop("_areas", "_hit")


def event_peaks(events: DataFrame, peaks: DataFrame, keys, event: str, et: str, t: str, x: str, after: float) -> DataFrame:
    """Peaks within ``after`` of each event: their number, the largest, the first and the largest one's latency."""
    a = align_to_events(events, peaks, keys, et, t, 0.0, after).groupBy(event).agg(
        F.count("*").alias("n_peaks"), F.max_by(x, F.struct(F.col(x), -F.col(t))).alias("largest"), F.min_by(x, t).alias("first_peak"), F.max_by("rel", F.struct(F.col(x), -F.col(t))).alias("latency"))
    return events.select(event).join(a, event, "left").fillna(0, ["n_peaks"])


def recovery(events: DataFrame, samples: DataFrame, keys, event: str, et: str, level: str, t: str, x: str, after: float) -> DataFrame:
    """Time until the signal first falls to half of the event's level."""
    a = align_to_events(events, samples, keys, et, t, 0.0, after).where(F.col("rel") > 0)
    return a.groupBy(event).agg(F.min(F.when(F.col(x) <= F.col(level) / 2, F.col("rel"))).alias("half_time"))


def in_polygon(points: DataFrame, polygons: DataFrame, key: str, x: str, y: str, most: int = 10_000) -> DataFrame:
    """(key, aoi) of the polygons that hold each point, by the parity of edges crossed to the right.

    ``polygons`` has aoi and vertices (array of struct x, y). Up to ``most`` edges
    are broadcast; beyond that, points meet the edges that cross their band of y, a
    band being as high as an edge is on average.
    """
    closed = F.concat("vertices", F.slice("vertices", 1, 1))
    edges = polygons.select("aoi", F.posexplode(closed).alias("k", "a"), closed.alias("v")).select("aoi", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.get("v", F.col("k") + 1).alias("b"))
    edges = edges.where("b is not null").select("aoi", "x1", "y1", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    spans = (F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))
    right = F.col(x) < F.try_divide((F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    if edges.limit(most + 1).count() <= most:
        hit = points.join(F.broadcast(edges), spans)
    else:
        high = edges.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 1.0
        band = lambda v: F.floor(v / high)
        cut = edges.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
        hit = points.withColumn("_band", band(F.col(y))).join(cut, "_band").where(spans)
    return hit.where(right).groupBy(key, "aoi").agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, "aoi")
