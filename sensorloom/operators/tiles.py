"""Recurrence plots, and entropies from them, on a grid of time tiles.

A recording of n points is cut into blocks of ``TILE``; every two blocks meet in
one row, and a task compares all their points with arrays, row after row. Nothing is a row a
pair: a task counts the runs of recurrent points along diagonals and columns that
end inside its tile by length, and sends on only the runs that touch a border of
it. Those are stitched line by line. The work stays quadratic in n, as the plot
is, but a task holds one tile and the shuffle n^2 / TILE values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.core import BEFORE, ordered, whole
from ..functions.ranges import matched, running

TILE = 1024


def places(df: DataFrame, keys, x, order) -> DataFrame:
    """(keys, rn, n, v): the valid samples with their place from 0 and their group's size."""
    x = F.col(x) if isinstance(x, str) else x
    d = df.select(*keys, *order, x.cast("double").alias("v")).where("v is not null")
    return running(d, keys, order, rn=F.lit(1).cast("long")).select(*keys, F.col("rn_before").alias("rn"), F.col("rn_total").alias("n"), "v")


def _tiles(points: DataFrame, keys, reach: int, tile: int) -> DataFrame:
    """(keys, lo, hi, n, tol, a, b): every two blocks of vectors of a group, each with the values its vectors reach."""
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - (tile + reach - 1)) / tile)).cast("long")
    last = F.least(F.floor(F.col("rn") / tile), F.floor((F.col("n") - reach - 1) / tile)).cast("long")
    d = points.where(F.col("n") > reach).withColumn("_from", first).withColumn("_to", last).where("_from <= _to")
    d = d.withColumn("_block", F.explode(F.sequence("_from", "_to")))
    b = d.groupBy(*keys, "_block").agg(F.first("n").alias("n"), F.first("tol").alias("tol"), F.array_sort(F.collect_list(F.struct("rn", "v"))).alias("_v"))
    b = b.withColumn("part", F.struct("_block", F.col("_v.v").alias("v"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - reach - 1) / tile).cast("long"))))
    b = b.groupBy(*keys, F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi")).agg(
        F.first("n").alias("n"), F.first("tol").alias("tol"), F.array_sort(F.collect_list("part")).alias("parts"))
    return b.select(*keys, "lo", "hi", "n", "tol", F.element_at("parts", 1)["v"].alias("a"), F.element_at("parts", -1)["v"].alias("b"))


def _near(a: np.ndarray, b: np.ndarray, m: int, delay: int, tol: float, metric: str) -> np.ndarray:
    """Which vectors of ``m`` values, ``delay`` apart, lie within ``tol``."""
    h, w = len(a) - (m - 1) * delay, len(b) - (m - 1) * delay
    steps = [np.abs(a[k * delay : k * delay + h, None] - b[None, k * delay : k * delay + w]) for k in range(m)]
    if metric == "max":
        return np.maximum.reduce(steps) <= tol
    return np.sqrt(sum(s * s for s in steps)) <= tol


def _runs(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, length) of the runs of True along the first axis."""
    lines = np.zeros((grid.shape[1], grid.shape[0] + 2), np.int8)
    lines[:, 1:-1] = grid.T
    at = np.flatnonzero(np.diff(lines.ravel()))
    start, stop = at[::2], at[1::2]
    size = grid.shape[0] + 2
    return start // size, start % size, stop - start


def _lines(near: np.ndarray, lo: int, hi: int, n: int, tile: int, kinds: str) -> list[tuple]:
    """(kind, len, at_end, k, line, start): counts of runs inside the tile, and the runs that touch its borders with their line and start."""
    h, w = near.shape
    found = []
    if "d" in kinds:
        upper = np.triu(near, 1) if lo == hi else near
        sheared = np.zeros((h, w + h), bool)
        sheared[:, :w] = upper[::-1]
        sheared = sheared.ravel()[: h * (w + h - 1)].reshape(h, w + h - 1)[::-1]  # column h - 1 + j - i
        col, i, size = _runs(sheared)
        j = col - (h - 1) + i
        start, stop = hi * tile + j, hi * tile + j + size  # of the later point
        ahead = ((i == 0) | (j == 0)) & (lo * tile + i > 0)
        after = ((i + size == h) | (j + size == w)) & (stop < n)
        found.append(("d", start - (lo * tile + i), start, size, ahead | after, stop == n))
    if "v" in kinds:
        for grid, rows, cols in [(near, lo, hi)] + ([(near.T, hi, lo)] if lo != hi else []):
            col, i, size = _runs(grid)
            start = rows * tile + i
            border = ((i == 0) & (start > 0)) | ((i + size == grid.shape[0]) & (start + size < n))
            found.append(("v", cols * tile + col, start, size, border, start + size == n))
    out = []
    for kind, line, start, size, border, end in found:
        inner = ~border
        key, k = np.unique(size[inner] * 2 + end[inner], return_counts=True)
        out.append((kind, key // 2, key % 2 == 1, k, np.full(len(key), -1), np.full(len(key), -1)))
        if border.any():
            out.append((kind, size[border], end[border], np.ones(border.sum(), int), line[border], start[border]))
    return out


FOUND = {"kind": StringType(), "len": LongType(), "at_end": BooleanType(), "k": LongType(), "line": LongType(), "start": LongType()}


def _series(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and where each list begins in them."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy()))


def run_counts(points: DataFrame, keys, m: int = 1, delay: int = 1, metric: str = "max", kinds: str = "d", tile: int | None = None) -> DataFrame:
    """(keys, kind, len, at_end, k): how many runs of recurrent vectors there are, by length.

    ``points`` has keys, rn, n, v and the tolerance ``tol``, one of a group. Kind
    'd' is diagonals above the main one, 'v' whole columns; ``at_end`` marks runs
    that end with the last vector.
    """
    tile = tile or TILE
    reach = (m - 1) * delay
    d = _tiles(points.where("tol >= 0"), keys, reach, tile)
    schema = StructType([*[d.schema[k] for k in keys], *[StructField(n, t) for n, t in FOUND.items()]])

    def gathered(batch, found):
        """The rows that tiles of ``batch`` gave: (place of the tile, what ``_lines`` found)."""
        sizes = [len(f[1]) for _, f in found]
        at = pa.array(np.repeat([r for r, _ in found], sizes))
        kind = pa.array(np.repeat([f[0] for _, f in found], sizes).astype(object), pa.string())
        rest = [pa.array(np.concatenate([f[k] for _, f in found])) for k in range(1, len(FOUND))]
        return pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], kind, *rest], names=[*keys, *FOUND])

    def work(batches):
        for batch in batches:
            lo, hi, n, tol = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "n", "tol"))
            (a, a_to), (b, b_to) = _series(batch.column("a")), _series(batch.column("b"))
            found, size = [], 0
            for r in range(batch.num_rows):
                near = _near(a[a_to[r] : a_to[r + 1]], b[b_to[r] : b_to[r + 1]], m, delay, tol[r], metric)
                lines = _lines(near, int(lo[r]), int(hi[r]), int(n[r]) - reach, tile, kinds)
                found += [(r, f) for f in lines]
                size += sum(len(f[1]) for f in lines)
                if size > 100_000:
                    yield gathered(batch, found)
                    found, size = [], 0
            if found:
                yield gathered(batch, found)

    found = d.mapInArrow(work, schema)
    inner = found.where("line < 0").select(*keys, "kind", "len", "at_end", "k")
    w = ordered([*keys, "kind", "line"], ["start"])
    open_ = found.where("line >= 0").withColumn("_new", F.coalesce((F.lag(F.col("start") + F.col("len")).over(w) != F.col("start")).cast("int"), F.lit(1)))
    open_ = open_.withColumn("_run", F.sum("_new").over(ordered([*keys, "kind", "line"], ["start"], BEFORE, 0)))
    open_ = open_.groupBy(*keys, "kind", "line", "_run").agg(F.sum("len").alias("len"), F.max("at_end").alias("at_end")).select(*keys, "kind", "len", "at_end", F.lit(1).cast("long").alias("k"))
    return inner.unionByName(open_).groupBy(*keys, "kind", "len", "at_end").agg(F.sum("k").alias("k"))


def recurrence_quantification(df: DataFrame, keys, x: str, order, m: int = 2, delay: int = 1, radius: float | None = None, multiplier: float = 0.2, line: int = 2, tile: int | None = None) -> DataFrame:
    """Recurrence rate, determinism, laminarity, trapping time, diagonal entropy, mean and longest diagonal of positive intervals.

    Vectors of ``m`` intervals, ``delay`` apart, recur within ``radius``
    (``multiplier`` SDs of all their values); the whole plot counts, main diagonal
    included. Groups too short have NULLs and say so.
    """
    reach, least = (m - 1) * delay, (m + 2) * delay + 5
    every = df.groupBy(*keys).agg(F.count_if(F.col(x) > 0).alias("n_intervals"))
    p = places(df.where(F.col(x) > 0), keys, x, order).where(F.col("n") >= least)
    # a value stands in as many vectors as it has places in them
    uses = sum(((F.col("rn") >= k * delay) & (F.col("rn") < F.col("n") - reach + k * delay)).cast("long") for k in range(m))
    p = p.withColumn("_u", uses)
    all_of = (F.col("n") - reach) * m
    mean = matched(p, p.groupBy(*keys).agg((F.sum(F.col("_u") * F.col("v")) / F.sum("_u")).alias("_m")), keys)
    sd = mean.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_u") * F.pow(F.col("v") - F.col("_m"), F.lit(2))) / (F.first(all_of) - 1)).alias("_sd"))
    tol = F.lit(float(radius)) if radius is not None else multiplier * F.col("_sd")
    sd = sd.select(*keys, F.when(tol > 0, tol).otherwise(2.0**-52).alias("tol"))
    runs = run_counts(matched(p, sd, keys), keys, m, delay, "euclid", "dv", tile)
    v, d, long_ = F.col("kind") == "v", F.col("kind") == "d", F.col("len") >= line
    by_len = runs.groupBy(*keys, "kind", "len").agg(F.sum("k").alias("k"))
    main = p.groupBy(*keys).agg((F.first("n") - reach).alias("len")).select(*keys, F.lit("d").alias("kind"), "len", F.lit(1).cast("long").alias("k"))
    # diagonals count on both sides of the main one
    by_len = by_len.withColumn("k", F.when(d, 2 * F.col("k")).otherwise(F.col("k"))).unionByName(main).groupBy(*keys, "kind", "len").agg(F.sum("k").alias("k"))
    k, points = F.col("k"), F.col("k") * F.col("len")
    s = by_len.withColumn("_all", F.sum(F.when(d & long_, k)).over(whole(keys))).withColumn("_p", k / F.col("_all"))
    some = lambda c, e: F.sum(F.when(c, e).otherwise(0))
    s = s.groupBy(*keys).agg(
        some(v, points).alias("_points"), some(d & long_, points).alias("_in_d"), some(v & long_, points).alias("_in_v"), some(v & long_, k).alias("_n_v"), some(d & long_, k).alias("_n_d"),
        F.sum(F.when(d & long_, -F.col("_p") * F.ln("_p"))).alias("diagonal_entropy"), F.max(F.when(d, F.col("len"))).alias("longest_diagonal"))
    n = (F.col("n_intervals") - reach).cast("double")
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    out = matched(every, s, keys, "left")
    return out.select(*keys, "n_intervals", (F.col("_points") / (n * n)).alias("recurrence_rate"), ratio("_in_d", "_points").alias("determinism"), ratio("_in_v", "_points").alias("laminarity"),
                      ratio("_in_v", "_n_v").alias("trapping_time"), "diagonal_entropy", ratio("_in_d", "_n_d").alias("mean_diagonal_length"), "longest_diagonal",
                      F.when(F.col("_points").isNull(), "insufficient_intervals").otherwise("hrv_rqa_extracted").alias("status"))


def match_counts(points: DataFrame, keys, m: int, tile: int | None = None) -> DataFrame:
    """(keys, short, long): pairs of windows of m and of m + 1 values that agree within ``tol``, all windows of each length."""
    over = lambda size: F.greatest(F.col("len") - (size - 1), F.lit(0)) * F.col("k")
    return run_counts(points, keys, 1, 1, "max", "d", tile).groupBy(*keys).agg(F.sum(over(m)).alias("short"), F.sum(over(m + 1)).alias("long"))


def refined_multiscale_entropy(df: DataFrame, keys, x: str, order, scales=(1, 2, 3, 4, 5), m: int = 2, multiplier: float = 0.2, least: int = 20, tile: int | None = None) -> DataFrame:
    """(keys, scale, match_count_m, match_count_m1, rcmse, status): matches of every offset's coarse series are pooled before the logarithm.

    The tolerance is ``multiplier`` SDs of the intervals themselves at every scale.
    """
    p = places(df.where(F.col(x) > 0), keys, x, order)
    size = df.groupBy(*keys).agg(F.count_if(F.col(x) > 0).alias("_n"), F.stddev_samp(F.when(F.col(x) > 0, F.col(x))).alias("_sd"))
    grid = size.withColumn("scale", F.explode(F.array(*map(F.lit, sorted(set(scales))))))
    fit = matched(p, size.where((F.col("_n") >= least) & (F.col("_sd") > 0)).select(*keys, (multiplier * F.col("_sd")).alias("tol")), keys)
    each = fit.withColumn("scale", F.explode(F.array(*map(F.lit, sorted(set(scales)))))).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("scale") - 1))).where("rn >= offset")
    each = each.withColumn("rn", F.col("rn") - F.col("offset")).withColumn("boxes", F.floor((F.col("n") - F.col("offset")) / F.col("scale"))).withColumn("box", F.floor(F.col("rn") / F.col("scale")))
    coarse = each.where((F.col("box") < F.col("boxes")) & (F.col("boxes") >= m + 2)).groupBy(*keys, "scale", "offset", F.col("box").alias("rn")).agg(F.first("boxes").alias("n"), F.first("tol").alias("tol"), F.avg("v").alias("v"))
    c = match_counts(coarse, [*keys, "scale", "offset"], m, tile).groupBy(*keys, "scale").agg(F.sum("short").alias("match_count_m"), F.sum("long").alias("match_count_m1"))
    out = matched(grid, c, [*keys, "scale"], "left")
    ok = (F.col("_n") >= least) & ~F.coalesce(F.col("_sd") == 0, F.lit(False))
    counts = [F.when(ok, F.coalesce(c, F.lit(0))).alias(c) for c in ("match_count_m", "match_count_m1")]
    value = F.when((F.col("match_count_m") > 0) & (F.col("match_count_m1") > 0), -F.ln(F.col("match_count_m1") / F.col("match_count_m")))
    out = out.select(*keys, "scale", "_n", "_sd", *counts).withColumn("rcmse", value)
    return out.select(*keys, "scale", "match_count_m", "match_count_m1", "rcmse", F.when(~ok, "insufficient_intervals").when(F.col("rcmse").isNull(), "rcmse_not_estimated").otherwise("rcmse_extracted").alias("status"))
