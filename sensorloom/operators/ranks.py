"""Kendall's tau-b with discordant pairs counted by joins of ranges, not by pairs.

Both values are cut into blocks of about sqrt(n) rows of their sorted order, a
value that fills a block alone getting its own. A discordant pair lies either in
one block of x, or in one block of y and different ones of x, or in different
blocks of both. Each kind is a weighted count of inversions over at most some
sqrt(n) places, taken bit by bit of the place: at every bit, rows of one prefix
meet in y order, and running sums of those with the bit clear meet those with it
set. No task orders a whole recording, and nothing is a row a pair. Groups of a
few hundred rows would only be multiplied by that; their pairs are compared in place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.core import BEFORE, ordered
from ..functions.ranges import kept, matched, running

#: Groups of at most this many rows are lists in one row.
SMALL = 512


def _blocks(values: DataFrame, keys, v: str, name: str) -> DataFrame:
    """(keys, v, name, n): the block of each distinct value; odd blocks hold one heavy value. ``values`` has its weight w."""
    d = running(values.groupBy(*keys, v).agg(F.sum("w").alias("w")), keys, [v], at=F.col("w"))
    width = F.ceil(F.sqrt(F.col("at_total").cast("double"))).cast("long")
    block = 2 * F.call_function("div", F.col("at_before"), width) + (F.col("w") >= width).cast("long")
    return d.select(*keys, v, block.alias(name), F.col("at_total").alias("n"))


def inversions(df: DataFrame, keys, a: Column, v: str, w: str, bits: Column) -> DataFrame:
    """(keys, k): summed products of the weights of rows with a < a' and v > v'; ``a`` is a place under 2^bits."""
    d = df.select(*keys, v, F.col(w).alias("_w"), a.cast("long").alias("_a"), F.explode(F.sequence(F.lit(0), bits.cast("int") - 1)).alias("_level"))
    set_ = F.call_function("shiftright", F.col("_a"), F.col("_level")).bitwiseAND(F.lit(1)) == 1
    prefix = F.call_function("shiftright", F.col("_a"), F.col("_level") + 1)
    g = d.groupBy(*keys, "_level", prefix.alias("_prefix"), v).agg(F.sum(F.when(set_, 0).otherwise(F.col("_w"))).alias("_low"), F.sum(F.when(set_, F.col("_w")).otherwise(0)).alias("_high"))
    above = F.sum("_low").over(ordered([*keys, "_level", "_prefix"], [F.desc(v)], BEFORE, -1))
    return g.select(*keys, (F.col("_high") * F.coalesce(above, F.lit(0))).alias("_k")).groupBy(*keys).agg(F.sum("_k").alias("k"))


def _pairs(df: DataFrame, keys, by, name: str) -> DataFrame:
    w = F.sum("w")
    g = df.groupBy(*keys, *by).agg(w.alias("_t"))
    return g.groupBy(*keys).agg(F.sum(F.call_function("div", F.col("_t") * (F.col("_t") - 1), F.lit(2))).alias(name))


def _by_ranges(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    d = df.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("w"))
    xs, ys = _blocks(d, keys, "_x", "_i"), _blocks(d, keys, "_y", "_j")
    d = matched(matched(d, xs, [*keys, "_x"]), ys.drop("n"), [*keys, "_y"])
    bits = F.length(F.bin(2 * F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long") + 2))
    light = lambda c: F.col(c) % 2 == 0
    inside = d.where(light("_i")).withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys, "_i").orderBy("_x")))
    cells = d.groupBy(*keys, "_i", "_j").agg(F.sum("w").alias("w"), F.first("n").alias("n"))
    kinds = [
        inversions(inside, [*keys, "_i"], F.col("_rank"), "_y", "w", bits + 1).select(*keys, "k"),
        inversions(d.where(light("_j")), [*keys, "_j"], F.col("_i"), "_y", "w", bits + 1).select(*keys, "k"),
        inversions(cells, keys, F.col("_i"), "_j", "w", bits + 1),
    ]
    dis = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy(*keys).agg(F.sum("k").alias("discordant"))
    out = d.groupBy(*keys).agg(F.sum("w").alias("n"))
    for part in (_pairs(d, keys, ["_x"], "_tx"), _pairs(d, keys, ["_y"], "_ty"), _pairs(d, keys, ["_x", "_y"], "_txy"), dis):
        out = matched(out, part, keys)
    every = F.call_function("div", F.col("n") * (F.col("n") - 1), F.lit(2))
    out = out.withColumn("concordant", every - F.col("_tx") - F.col("_ty") + F.col("_txy") - F.col("discordant"))
    return _tau(out, keys)


def _by_size(df: DataFrame, keys) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``SMALL`` rows, and those of larger ones (None if there are none)."""
    large = kept(df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > SMALL).select(*keys))
    if large.isEmpty():
        return df, None
    return matched(df, large, keys, "left_anti"), matched(df, large, keys, "left_semi")


def _counts(xs, ys) -> list[int]:
    """Concordant and discordant pairs, and those equal in x and in y, of one small group."""
    x, y = np.asarray(xs, float), np.asarray(ys, float)
    more, above = x[:, None] > x, y[:, None] > y
    count, every = np.count_nonzero, len(x) * (len(x) - 1) // 2
    both = count(more & above)
    return [both, count(more & above.T), every - count(more), every - count(above)]


def _counted(lists: DataFrame, keys) -> DataFrame:
    """The table of ``kendall`` for small groups, from (keys, _p), the list of their known pairs (x, y)."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("concordant", "discordant", "_tx", "_ty")])

    @F.pandas_udf(schema)
    def pairs(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_counts(a, b) for a, b in zip(x, y)], columns=schema.names, dtype="int64")

    side = lambda name: F.transform("_p", lambda p: p[name].cast("double"))
    return _tau(lists.where(F.size("_p") > 0).select(*keys, F.size("_p").cast("long").alias("n"), pairs(side("x"), side("y")).alias("_c")).select(*keys, "n", "_c.*"), keys)


def _tau(counts: DataFrame, keys) -> DataFrame:
    every = F.call_function("div", F.col("n") * (F.col("n") - 1), F.lit(2))
    scale = F.sqrt((every - F.col("_tx")).cast("double")) * F.sqrt((every - F.col("_ty")).cast("double"))
    tau = F.when(F.col("n") >= 3, F.try_divide(F.col("concordant") - F.col("discordant"), F.nullif(scale, F.lit(0.0))))
    return counts.select(*keys, "n", "concordant", "discordant", tau.alias("tau"))


def kendall(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """(keys, n, concordant, discordant, tau): tau-b over rows where both are known; NULL under three of them or where one is constant.

    Groups of at most ``SMALL`` rows are lists whose pairs are compared in the task that holds them; larger ones are counted by ranges.
    """
    keys = list(keys)
    few, many = _by_size(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), keys)
    out = _counted(few.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("_p")), keys)
    return out if many is None else out.unionByName(_by_ranges(many, keys, "_x", "_y"))


def rank_correlation(df: DataFrame, keys, x: str, y: str, order, lag_max: int = 0) -> DataFrame:
    """(keys, n, correlation, best_lag, best_lag_correlation) by Kendall; x at a row meets y ``lag`` rows before it.

    The best lag has the greatest absolute value, the first of equals. Groups
    without three pairs have NULLs.
    """
    keys, span = list(keys), range(-lag_max, lag_max + 1)
    few, many = _by_size(df, keys) if all(isinstance(o, str) for o in order) else (df.limit(0), df)
    # small groups are put in order as lists, and a lag takes two slices of them
    names = [f"_o{k}" for k in range(len(order))]
    rows = F.struct(*[F.col(o).alias(n) for n, o in zip(names, order) if isinstance(o, str)], F.col(x).alias("x"), F.col(y).alias("y"))
    lists = few.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(rows)).alias("_r"))

    def shifted(k: int) -> Column:
        size = F.greatest(F.size("_r") - abs(k), F.lit(0))
        here, there = (F.slice("_r", F.lit(max(v, 0) + 1), size) for v in (k, -k))
        pairs = F.zip_with(here, there, lambda p, q: F.struct(p["x"].alias("x"), q["y"].alias("y")))
        return F.struct(F.lit(k).alias("lag"), F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("_p"))

    t = _counted(lists.select(*keys, F.explode(F.array(*map(shifted, span))).alias("_l")).select(*keys, "_l.*"), [*keys, "lag"])
    if many is not None:
        w = ordered(keys, order)
        lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lag(y, k) if k >= 0 else F.lead(y, -k)).over(w).alias("_there")) for k in span])
        each = many.select(*keys, F.col(x).alias("_here"), lags.alias("_p")).select(*keys, "_here", F.explode("_p").alias("_p")).select(*keys, "_here", "_p.*")
        t = t.unionByName(kendall(each, [*keys, "lag"], "_here", "_there"))
    strength = F.struct(F.round(F.abs("tau"), 12), -F.col("lag"))
    at0, finite = F.col("lag") == 0, F.col("tau").isNotNull()
    best = t.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(at0, F.col("n"))), F.lit(0)).alias("n"), F.max(F.when(at0, F.col("tau"))).alias("correlation"),
        F.max_by(F.when(finite, F.col("lag")), F.when(finite, strength)).alias("best_lag"), F.max_by("tau", F.when(finite, strength)).alias("best_lag_correlation"))
    every = df.select(*keys).distinct()
    return matched(every, best, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
