"""Spectra, filters, lagged regressions and phase locking of recordings.

Only phase locking still holds one recording in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.core import last_known, next_known, ordered, whole
from .scans import second_order
from .tiles import places


def grouped(df: DataFrame, key: str, columns, order, fit, schema: str) -> DataFrame:
    """``fit`` of each group's ordered columns as float arrays gives a dict of columns (scalars or equal-length arrays)."""
    kind = df.schema[key].dataType.simpleString()
    names = [p.split()[0] for p in schema.split(", ")]

    def run(pdf):
        pdf = pdf.sort_values(list(order))
        out = fit(*[pdf[c].to_numpy(float) for c in columns])
        size = max([len(v) for v in out.values() if isinstance(v, (list, np.ndarray))], default=1)
        rows = pd.DataFrame({n: out[n] if isinstance(out[n], (list, np.ndarray)) else [out[n]] * size for n in names})
        rows.insert(0, key, pdf[key].iloc[0])
        return rows

    need = list(dict.fromkeys([key, *columns, *order]))
    return df.select(*need).groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def power_spectrum(df: DataFrame, key: str, x: str, order, rate: float, size: int = 64) -> DataFrame:
    """(key, f, power): averaged Hann periodograms of half-overlapping segments of ``size`` samples, or of the whole of a shorter recording.

    Samples get their place by ranges and go to the two segments that hold them;
    a segment's transform is sums of products, so a recording is spread over its
    segments. Recordings of under four samples have no spectrum.
    """
    p = places(df, [key], x, order).where("n >= 4").withColumn("_size", F.least(F.lit(size), F.col("n")))
    half = F.greatest(F.lit(1), F.floor(F.col("_size") / 2))
    last = F.floor((F.col("n") - F.col("_size")) / half)
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - F.col("_size") + 1) / half))
    p = p.withColumn("_from", first.cast("long")).withColumn("_to", F.least(last, F.floor(F.col("rn") / half)).cast("long")).where("_from <= _to")  # samples behind the last whole segment are in none
    p = p.withColumn("_segment", F.explode(F.sequence("_from", "_to")))
    p = p.withColumn("_j", F.col("rn") - F.col("_segment") * half).withColumn("_w", 0.5 - 0.5 * F.cos(2 * math.pi * F.col("_j") / (F.col("_size") - 1)))
    p = p.withColumn("_y", F.col("_w") * (F.col("v") - F.avg("v").over(whole([key, "_segment"]))))
    angle = lambda f: F.lit(2 * math.pi * f) * F.col("_j") / F.col("_size")
    parts = [e.alias(f"_{n}{f}") for f in range(size // 2 + 1) for n, e in (("c", F.sum(F.col("_y") * F.cos(angle(f)))), ("s", F.sum(F.col("_y") * F.sin(angle(f)))))]
    s = p.groupBy(key, "_segment").agg(F.first("_size").alias("_size"), F.sum(F.col("_w") * F.col("_w")).alias("_e"), *parts)
    power = F.array(*[F.struct(F.lit(f).alias("_f"), ((F.col(f"_c{f}") * F.col(f"_c{f}") + F.col(f"_s{f}") * F.col(f"_s{f}")) / (rate * F.col("_e"))).alias("_p")) for f in range(size // 2 + 1)])
    g = s.select(key, "_size", F.explode(power).alias("_b")).where(F.col("_b._f") <= F.col("_size") / 2)
    return g.groupBy(key, (F.col("_b._f") * rate / F.col("_size")).alias("f")).agg(F.avg("_b._p").alias("power"))


def band_powers(spectrum: DataFrame, key: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Power summed over half-open bands of a spectrum table."""
    return spectrum.groupBy(key).agg(*[F.coalesce(F.sum(F.when((F.col("f") >= lo) & (F.col("f") < hi), F.col("power"))), F.lit(0.0)).alias(n) for n, (lo, hi) in bands.items()])


def _solved(moments: np.ndarray, target: int, others: list[int]) -> float:
    """Residual sum of squares of one variable on others, from their matrix of products."""
    if not others:
        return float(moments[target, target])
    m, v = moments[np.ix_(others, others)], moments[others, target]
    return float(moments[target, target] - v @ np.linalg.pinv(m, hermitian=True) @ v)


def _matrix(row: pd.Series, size: int, prefix: str) -> np.ndarray:
    out = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = row[f"{prefix}_{i}_{j}"]
    return out


def ar_spectrum_order(df: DataFrame, key: str, x: str, order, most: int) -> DataFrame:
    """Autoregression by least squares; the order of least AIC and its residual variance.

    One aggregation sums the products of lagged samples; only these few numbers of a recording are solved.
    """
    w = ordered([key], order)
    d = df.where(F.col(x).isNotNull()).select(key, *order, (F.col(x) - F.avg(x).over(whole([key]))).alias("v"))
    d = d.select(key, F.row_number().over(w).alias("rn"), *[F.lag("v", k).over(w).alias(f"v{k}") for k in range(most + 1)])
    sums = [F.sum(F.when(F.col("rn") > p, F.col(f"v{i}") * F.col(f"v{j}"))).alias(f"p{p}_{i}_{j}") for p in range(most + 1) for i in range(p + 1) for j in range(i, p + 1)]
    kind = df.schema[key].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                n = int(r["n"])
                best = (np.inf, 0, r["p0_0_0"] / n)
                for p in range(1, most + 1):
                    if n - p <= 2 * p:
                        break
                    s = _solved(_matrix(r, p + 1, f"p{p}"), 0, list(range(1, p + 1))) / (n - p)
                    if s > 0 and (aic := (n - p) * math.log(s) + 2 * p) < best[0]:
                        best = (aic, p, s)
                rows.append((r[key], best[1], best[2]))
            yield pd.DataFrame(rows, columns=[key, "ar_order", "residual_var"])

    return d.groupBy(key).agg(F.count("*").alias("n"), *sums).mapInPandas(solve, f"{key} {kind}, ar_order long, residual_var double")


def granger(df: DataFrame, key: str, x: str, y: str, order, lags: int) -> DataFrame:
    """F statistics for x leading y and y leading x on a number of lags, from the covariances of the lagged samples; NULL for short recordings."""
    w = ordered([key], order)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.select(key, F.row_number().over(w).alias("rn"), *[F.lag(F.col(c).cast("double"), k).over(w).alias(f"c{i * (lags + 1) + k}") for i, c in enumerate((x, y)) for k in range(lags + 1)])
    size = 2 * (lags + 1)
    full = lambda e: F.when(F.col("rn") > lags, e)
    sums = [F.covar_pop(full(F.col(f"c{i}")), full(F.col(f"c{j}"))).alias(f"c_{i}_{j}") for i in range(size) for j in range(i, size)]
    kind = df.schema[key].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                n, m = int(r["n"]), lags + 1
                stats = [None, None]
                if n > 4 * lags + 4:
                    c, df2 = _matrix(r, size, "c"), n - lags - 2 * lags - 1
                    for k, (target, other) in enumerate(((m, 0), (0, m))):
                        own = [target + j for j in range(1, m)]
                        small, large = _solved(c, target, own), _solved(c, target, own + [other + j for j in range(1, m)])
                        if df2 > 0 and large > 0:
                            stats[k] = (small - large) / lags / (large / df2)
                rows.append((r[key], n, *stats))
            yield pd.DataFrame({n: pd.array([v[k] for v in rows], t) for k, (n, t) in enumerate([(key, pdf[key].dtype), ("n", "Int64"), ("x_to_y", "Float64"), ("y_to_x", "Float64")])})

    return d.groupBy(key).agg(F.count("*").alias("n"), *sums).mapInPandas(solve, f"{key} {kind}, n long, x_to_y double, y_to_x double")


def phase_locking(df: DataFrame, key: str, x: str, y: str, order) -> DataFrame:
    """Phase-locking value of two signals by their analytic signals."""

    def phase(v):
        n = len(v)
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        return np.angle(np.fft.ifft(np.fft.fft(v - v.mean()) * h))

    def fit(a, b):
        ok = np.isfinite(a) & np.isfinite(b)
        a, b = a[ok], b[ok]
        return {"n": len(a), "plv": float(abs(np.exp(1j * (phase(a) - phase(b))).mean())) if len(a) > 3 else np.nan}

    return grouped(df, key, [x, y], order, fit, "n long, plv double")


def low_pass(df: DataFrame, key: str, x: str, order, cutoff: float, rate: float) -> DataFrame:
    """(key, id, filtered): second-order recursive low-pass of each recording, at rest on its first value.

    Missing samples hold the last value, those ahead of the first one take it; a
    recording without any has NULLs. The id is the last column of ``order``.
    """
    w = math.tan(math.pi * cutoff / rate)
    k = 1 / (1 + math.sqrt(2) * w + w * w)
    b0, a1, a2 = w * w * k, 2 * (w * w - 1) * k, (1 - math.sqrt(2) * w + w * w) * k
    known = F.coalesce(last_known(x, [key], order), next_known(x, [key], order)).cast("double")
    d = df.select(key, *order, known.alias("_x"))
    out = second_order(d.where("_x is not null"), [key], order, "_x", (a1, a2), (b0, 2 * b0, b0), "filtered")
    none = d.where("_x is null").select(key, F.col(order[-1]).alias("id"), F.lit(None).cast("double").alias("filtered"))
    return out.select(key, F.col(order[-1]).alias("id"), "filtered").unionByName(none)
