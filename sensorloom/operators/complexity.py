"""Recurrence, sample entropy and detrended fluctuation of recordings.

Recurrence and entropy count runs along the diagonals of the recurrence plot: line
lengths, and matches of m points (a run of l pairs has l - m + 1 of them). The
plot is taken tile by tile (``tiles``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import BEFORE, ordered, whole
from ..functions.ranges import matched
from .tiles import places, run_counts


def _points(df: DataFrame, keys, x: str, order, radius: float) -> tuple[DataFrame, DataFrame]:
    """Valid samples with their place and tolerance, ``radius`` SDs; and (keys, n, tol)."""
    size = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), (radius * F.stddev_samp(F.col(x).cast("double"))).alias("tol"))
    return matched(places(df, keys, x, order), size.where("tol > 0").select(*keys, "tol"), keys), size


def recurrence(df: DataFrame, keys, x: str, order, radius: float = 0.2, line: int = 2) -> DataFrame:
    """Recurrence rate and determinism within ``radius`` SDs; NULL under four samples or without spread."""
    p, size = _points(df, keys, x, order, radius)
    points = F.col("len") * F.col("k")
    runs = run_counts(p, keys).groupBy(*keys).agg(F.sum(points).alias("pairs"), F.sum(F.when(F.col("len") >= line, points).otherwise(0)).alias("inside"))
    n, ok = F.col("n").cast("double"), (F.col("n") >= 4) & (F.col("tol") > 0)
    rate = F.when(ok, 2 * F.coalesce("pairs", F.lit(0)) / (n * (n - 1)))
    return matched(size, runs, keys, "left").select(*keys, "n", rate.alias("rate"), F.when(ok, F.try_divide("inside", F.nullif("pairs", F.lit(0)))).alias("determinism"))


def sample_entropy(df: DataFrame, keys, x: str, order, m: int = 2, radius: float = 0.2) -> DataFrame:
    """-ln(A / B) with A and B the pairs that agree over m + 1 and over m points; templates start at the first n - m samples. NULL where either is 0."""
    p, size = _points(df, keys, x, order, radius)
    over = lambda k: F.greatest(F.col("len") - (k - 1), F.lit(0))
    late = (F.col("at_end") & (F.col("len") >= m)).cast("long")
    counts = run_counts(p, keys).groupBy(*keys).agg(F.sum((over(m) - late) * F.col("k")).alias("short"), F.sum(over(m + 1) * F.col("k")).alias("long"))
    entropy = F.when((F.col("long") > 0) & (F.col("short") > 0), -F.ln(F.col("long") / F.col("short")))
    return matched(size, counts, keys, "left").select(*keys, "n", entropy.alias("entropy"))


def multiscale_entropy(df: DataFrame, keys, x: str, order, scales=(1, 2, 3), m: int = 2, radius: float = 0.2) -> DataFrame:
    """Sample entropy of the means of every ``scale`` samples; NULL where fewer than ten of them would be left."""
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("v"), F.row_number().over(ordered(keys, order)).alias("rn"), F.count("*").over(whole(keys)).alias("of"))
    d = d.withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).withColumn("box", F.floor((F.col("rn") - 1) / F.col("scale")))
    boxes = d.groupBy(*keys, "scale", "box").agg(F.avg("v").alias("v"), F.count("*").alias("k"), F.first("of").alias("of")).where("k = scale")
    e = sample_entropy(boxes.where("of >= 10 * scale"), [*keys, "scale"], "v", ["box"], m, radius)
    every = boxes.select(*keys, "scale").distinct()
    return matched(every, e.select(*keys, "scale", "entropy"), [*keys, "scale"], "left")


def detrended_fluctuation(df: DataFrame, keys, x: str, order, sizes=(4, 6, 8, 12, 16, 24, 32)) -> DataFrame:
    """Slope of log fluctuation on log box size, from the regression sums of each box; NULL with fewer than two sizes."""
    w = ordered(keys, order)
    d = df.where(F.col(x).isNotNull()).withColumn("_c", F.col(x) - F.avg(x).over(whole(keys)))
    d = d.select(*keys, F.sum("_c").over(ordered(keys, order, BEFORE, 0)).alias("y"), (F.row_number().over(w) - 1).alias("at"), F.count("*").over(whole(keys)).alias("n"))
    d = d.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("n >= 2 * size and at < n - n % size").withColumn("box", F.floor(F.col("at") / F.col("size")))
    at = F.col("at").cast("double")
    box = d.groupBy(*keys, "size", "box").agg((F.regr_syy("y", at) - F.regr_sxy("y", at) * F.regr_sxy("y", at) / F.regr_sxx("y", at)).alias("rest"))
    f = box.groupBy(*keys, "size").agg((F.greatest(F.avg("rest"), F.lit(0.0)) / F.col("size")).alias("f2")).where("f2 > 1e-18")
    return f.groupBy(*keys).agg(F.when(F.count("*") > 1, F.regr_slope(F.ln("f2") / 2, F.ln("size"))).alias("dfa"))
