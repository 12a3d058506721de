"""Convolution models with several conditions: design columns from events, and least squares from one aggregation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import finite, last_known, median, next_known, ordered
from ..functions.ranges import matched, running

# Shape and scale of the gamma densities of each response, and their weights.
RESPONSES = {"scr": ((3, 1.5, 1.0),), "canonical": ((6, 1.0, 1.0), (16, 1.0, -0.35)), "boxcar": ()}


def _response(t: Column, kind: str) -> Column:
    if not RESPONSES[kind]:
        return F.lit(1.0)
    return sum(w / (math.gamma(a) * s**a) * F.pow(t, F.lit(a - 1.0)) * F.exp(-t / s) for a, s, w in RESPONSES[kind])


def _impulses(points: DataFrame, events: DataFrame, keys, dt: DataFrame) -> DataFrame:
    """(keys, condition, j, w): how often an event of a condition sets sample j: the nearest one, or all within its duration.

    ``points`` has each time once with its first and last sample number. Events meet them in one union in time order.
    """
    e = matched(events, dt.select(*keys, "_dt"), keys).withColumn("_long", F.coalesce(F.col("_for") > F.col("_dt"), F.lit(False)))
    ends = F.array(F.struct(F.col("_on").alias("at"), F.lit(1).alias("kind")), F.when(F.col("_long"), F.struct((F.col("_on") + F.col("_for")).alias("at"), F.lit(2).alias("kind"))))
    e = e.withColumn("_e", F.explode(F.array_compact(ends))).select(*keys, "_condition", "_event", "_long", "_on", "_e.*")
    p = points.select(*keys, F.col("_t").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("_t").alias("t"), "lo", "hi").alias("p"))
    u = p.unionByName(e, allowMissingColumns=True)
    u = u.withColumn("a", last_known("p", keys, ["at", "kind"])).withColumn("b", next_known("p", keys, ["at", "kind"], 1)).where("kind > 0")
    back = F.col("b").isNull() | (F.col("at") - F.col("a.t") <= F.col("b.t") - F.col("at"))
    near = F.when(back, F.col("a.lo")).otherwise(F.col("b.lo"))
    start = F.when(F.col("kind") == 1, F.when(~F.col("_long"), near).when(F.col("a.t") == F.col("at"), F.col("a.lo")).otherwise(F.col("b.lo")))
    stop = F.when(F.col("kind") == 2, F.col("a.hi")).when(~F.col("_long"), near)
    span = u.groupBy(*keys, "_condition", "_event").agg(F.max(start).alias("lo"), F.max(stop).alias("hi")).where("lo <= hi")
    return span.withColumn("j", F.explode(F.sequence("lo", "hi"))).groupBy(*keys, "_condition", "j").agg(F.count("*").alias("w"))


def glm_design(samples: DataFrame, events: DataFrame, keys, t: str, order, onset: str, condition: str, conditions, duration: str | None = None, response: str = "scr", length: float = 20.0, derivative: bool = False) -> DataFrame:
    """``samples`` with ``intercept`` and, for each condition, ``pspm_<condition>`` and, if asked for, ``pspm_<condition>_derivative``.

    Impulses at the samples nearest to the events (the earlier of two; all samples
    of an event longer than the step) are convolved, sample by sample, with the
    response at the median step, of peak 1. ``order`` starts with ``t`` and tells
    rows apart. Samples without a time and events without an onset do not count.
    Samples and impulses meet in stretches as long as the response.
    """
    keys = list(keys)
    s = running(samples.where(finite(F.col(t).cast("double")).isNotNull()), keys, order, _i=F.lit(1).cast("long")).withColumnRenamed("_i_before", "_i").drop("_i_total")
    points = s.groupBy(*keys, F.col(t).cast("double").alias("_t")).agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"))
    step = points.withColumn("_d", F.col("_t") - F.lag("_t").over(ordered(keys, ["_t"])))
    dt = step.groupBy(*keys).agg(median("_d").alias("_dt")).where("_dt > 0").withColumn("_k", F.ceil((length + 0.5 * F.col("_dt")) / F.col("_dt")).cast("long"))
    shape = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda k: F.abs(_response(k * F.col("_dt"), response)))
    dt = dt.withColumn("_peak", F.array_max(shape))
    e = events.select(*keys, F.col(condition).cast("string").alias("_condition"), finite(F.col(onset).cast("double")).alias("_on"), (F.col(duration).cast("double") if duration else F.lit(0.0)).alias("_for"))
    e = e.where(F.col("_on").isNotNull() & F.col("_condition").isin(*conditions)).groupBy(*e.columns).agg(F.count("*").alias("_copies"))
    e = e.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).withColumn("_event", F.struct("_on", "_for", "_copy")).drop("_copies", "_copy")
    hits = matched(_impulses(points, e, keys, dt), dt, keys)
    hits = hits.withColumn("_b", F.explode(F.array(F.call_function("div", F.col("j"), F.col("_k")), F.call_function("div", F.col("j"), F.col("_k")) + 1)))
    at = matched(s.select(*keys, "_i"), dt.select(*keys, F.col("_k").alias("_width")), keys).withColumn("_b", F.call_function("div", F.col("_i"), F.col("_width")))
    lag = F.col("_i") - F.col("j")
    both = matched(at, hits, [*keys, "_b"]).where((lag >= 0) & (lag < F.col("_k")))
    value = F.col("w") * _response(lag * F.col("_dt"), response) / F.col("_peak")
    names = {c: f"pspm_{c}" for c in conditions}
    sums = both.groupBy(*keys, "_i").agg(*[F.sum(F.when(F.col("_condition") == c, value)).alias(n) for c, n in names.items()])
    out = matched(matched(s, sums, [*keys, "_i"], "left").fillna(0.0, list(names.values())), dt.select(*keys, "_dt"), keys).withColumn("intercept", F.lit(1.0))
    if derivative:
        for n in names.values():
            out = out.withColumn(n + "_derivative", F.coalesce((F.col(n) - F.lag(n).over(ordered(keys, ["_i"]))) / F.col("_dt"), F.lit(0.0)))
    return out.drop("_i", "_dt")


def _tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    known = np.isfinite(t) & (df > 0)
    t2, n = np.where(known, t, 1.0) ** 2, np.where(known, df, 1).astype(float)
    x, a, b = n / (n + t2), n / 2, np.full(n.shape, 0.5)
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    size, at = np.unique(n, return_inverse=True)
    scale = np.array([math.lgamma(v / 2 + 0.5) - math.lgamma(v / 2) - math.lgamma(0.5) for v in size])[at].reshape(n.shape)
    inside = (x > 0) & (x < 1)
    u = np.where(inside, x, 0.5)
    front = np.where(inside, np.exp(scale + a * np.log(u) + b * np.log1p(-u)) / a, 0.0)
    c, d = np.ones(n.shape), 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            f = f * (c * d)
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    p = front * f
    return np.where(known, np.minimum(1.0, np.where(swap, 1 - p, p)), np.where(np.isinf(t) & (df > 0), 0.0, np.nan))


def glm_fit(design: DataFrame, keys, y: str, regressors) -> DataFrame:
    """(keys, term, estimate, std_error, statistic, p_value, n, rank, df_residual, rss, r_squared, aic), a row a regressor.

    One aggregation gives each group's sums of products; matrices of the number of
    regressors are solved for a batch of groups at once. Rows with any missing value are left out. Linearly
    dependent regressors get the shortest solution and no standard errors.
    """
    keys, regressors = list(keys), list(regressors)
    columns = [F.col(c).cast("double") for c in (*regressors, y)]
    d = design.select(*keys, *[finite(c).alias(f"_x{k}") for k, c in enumerate(columns)]).dropna(subset=[f"_x{k}" for k in range(len(columns))])
    p = len(regressors)
    y_ = F.col(f"_x{p}")
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    n = F.count("*")
    # sums of products with the deviations of y from its mean are covariances, which one pass gives without loss
    sums = [F.sum(F.col(f"_x{a}") * F.col(f"_x{b}")) for a, b in pairs] + [n * F.covar_pop(F.col(f"_x{a}"), y_) for a in range(p)] + [F.sum(F.col(f"_x{a}")) for a in range(p)]
    g = d.groupBy(*keys).agg(n.alias("n"), F.array(F.avg(y_), n * F.var_pop(y_), *sums).alias("_s"))
    kinds = dict(g.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + (
        "term string, estimate double, std_error double, statistic double, p_value double, n long, rank long, df_residual long, rss double, r_squared double, aic double")
    names = [*keys, "term", "estimate", "std_error", "statistic", "p_value", "n", "rank", "df_residual", "rss", "r_squared", "aic"]

    def solve(batches):
        for batch in batches:
            groups = batch.num_rows
            if not groups:
                continue
            s = np.asarray(batch.column("_s").flatten(), float).reshape(groups, -1)
            mean, tss, n = s[:, 0], s[:, 1], np.asarray(batch.column("n"))
            gram = np.empty((groups, p, p))
            for k, (a, b) in enumerate(pairs):
                gram[:, a, b] = gram[:, b, a] = s[:, 2 + k]
            xd, x1 = s[:, 2 + len(pairs) :][:, :p], s[:, 2 + len(pairs) + p :]
            rank = np.linalg.matrix_rank(gram, hermitian=True)
            full = rank == p
            inverse = np.empty_like(gram)
            inverse[full], inverse[~full] = np.linalg.inv(gram[full]), np.linalg.pinv(gram[~full], hermitian=True)
            part, level = np.einsum("gab,gb->ga", inverse, xd), np.einsum("gab,gb->ga", inverse, x1)  # of the deviations, and of a constant
            beta = part + mean[:, None] * level
            dot = lambda u, v: np.einsum("ga,ga->g", u, v)
            through = lambda u, v: np.einsum("ga,gab,gb->g", u, gram, v)
            # residuals of y are those of its deviations plus the mean times those of a constant
            rest = tss - 2 * dot(part, xd) + through(part, part) + 2 * mean * (0 - dot(level, xd) - dot(part, x1) + through(part, level)) + mean**2 * (n - 2 * dot(level, x1) + through(level, level))
            rest, free = np.maximum(0.0, rest), np.maximum(0, n - rank)
            with np.errstate(divide="ignore", invalid="ignore"):
                se = np.where((full & (free > 0))[:, None], np.sqrt(np.diagonal(inverse, axis1=1, axis2=2) * (rest / free)[:, None]), np.nan)
                stat = beta / se
                r2, aic = np.where(tss > 0, 1 - rest / tss, np.nan), np.where(rest > 0, n * np.log(rest / n) + 2 * p, np.nan)
                tail = _tail(stat, np.repeat(free, p).reshape(groups, p))
            each = np.repeat(np.arange(groups), p)
            cells = [regressors * groups, beta.ravel(), se.ravel(), stat.ravel(), tail.ravel(), n[each], rank[each].astype(np.int64), free[each], rest[each], r2[each], aic[each]]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(each)) for k in keys], *[pa.array(c) for c in cells]], names=names)

    fit = g.mapInArrow(solve, schema)
    return fit.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if k == "double" and c not in keys else F.col(c) for c, k in fit.dtypes])
