"""Recurrences along a recording, computed in time blocks that run side by side.

A recurrence whose step is v -> (a v + b) / (c v + d) is a 2 x 2 matrix, and steps
compose by matrix product. Each time block multiplies its own matrices, the few
products of a unit are chained, and every block then runs from its own entry
value. Python holds one Arrow batch at a time, however long blocks and units are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.core import BEFORE, ordered, quantile
from ..functions.ranges import matched, running

STEP = ("_a", "_b", "_c", "_d")


def _prefixes(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Products of each group's steps so far, by doubling; ``at`` is the place in the group, which lies in one piece."""
    reach = 1
    while reach <= at.max():
        k = np.flatnonzero(at >= reach)
        a, b, c, d = m[:, k]
        e, f, g, h = m[:, k - reach]
        p = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        m[:, k] = p / np.abs(p).max(axis=0)
        reach *= 2
    return m


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, first, at): the steps of a batch, where the group of each row begins in it, and the row's place behind that."""
    m = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STEP]).astype(float)
    here = np.arange(batch.num_rows)
    first = np.maximum.accumulate(np.where(batch.column("_row").to_numpy() == 1, here, 0))
    return m, first, here - first


def _products(kept):
    """One row a group, ``kept`` and the product of its steps; groups may go on from batch to batch."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m, first, at = _opened(batch)
            if batch.column("_row")[0].as_py() > 1:
                a, b, c, d = m[:, 0].copy()
                e, f, g, h = (last.column(n)[0].as_py() for n in STEP)
                m[:, 0] = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
            elif last is not None:
                yield last
            m = _prefixes(m, at)
            ends = np.flatnonzero(np.append(first[1:] != first[:-1], True))
            out = pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(ends)) for n in kept], *[pa.array(v[ends]) for v in m]], names=[*kept, *STEP])
            if len(ends) > 1:
                yield out.slice(0, len(ends) - 1)
            last = out.slice(len(ends) - 1)
        if last is not None:
            yield last

    return run


def _values(kept, start: str):
    """``kept`` and the value after and before each row, from the group's ``start``; groups may go on from batch to batch."""

    def run(batches):
        carry = float("nan")
        for batch in batches:
            if not batch.num_rows:
                continue
            m, first, at = _opened(batch)
            v = batch.column(start).to_numpy(zero_copy_only=False).astype(float)[first]
            if batch.column("_row")[0].as_py() > 1:
                v[first == 0] = carry
            a, b, c, d = _prefixes(m, at)
            after = (a * v + b) / (c * v + d)
            before = np.where(at == 0, v, np.append(v[:1], after[:-1]))
            carry = after[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(after, from_pandas=True), pa.array(before, from_pandas=True)], names=[*kept, "_after", "_before"])

    return run


def _lined_up(d: DataFrame, keys, order) -> DataFrame:
    """Rows group by group in order, with their place (``_row``) from 1."""
    return d.withColumn("_row", F.row_number().over(ordered(keys, order))).sortWithinPartitions(*keys, "_row")


def recur(df: DataFrame, keys, order, width: float, step: tuple[Column, Column, Column, Column], start: str, name: str) -> DataFrame:
    """Adds ``name``, the value after each row, and ``name_before``; ``order`` begins with the time, blocks are ``width`` of it.

    ``start`` is a column that is constant in each unit; where it is NULL so are
    all values. Groups stream through Python side by side in Arrow batches, so
    that many short ones cost no more than a few long ones.
    """
    parts = [f"_k{k}" for k in range(len(keys))]
    d = df.select("*", *[e.cast("double").alias(n) for n, e in zip(STEP, step)], *[F.col(k).alias(p) for k, p in zip(keys, parts)], F.floor(F.col(order[0]) / width).alias("_block"))
    block = [*parts, "_block"]
    fields = lambda *names: StructType([*[d.schema[k] for k in block], *[StructField(n, DoubleType()) for n in names]])
    need = d.select(*dict.fromkeys([*block, *order, *STEP]), F.col(start).cast("double").alias("_v"))
    blocks = _lined_up(need, block, order).mapInArrow(_products([*block, "_v"]), fields("_v", *STEP))
    entry = _lined_up(blocks, parts, ["_block"]).mapInArrow(_values(block, "_v"), fields("_after", "_before"))
    d = matched(d, entry.select(*block, F.col("_before").alias("_entry")), block, "left")
    out = _lined_up(d, block, order).mapInArrow(_values(df.columns, "_entry"), StructType([*df.schema.fields, *fields("_after", "_before").fields[-2:]]))
    return out.withColumnsRenamed({"_after": name, "_before": f"{name}_before"})


def fuse_two(df: DataFrame, keys, primary: str, secondary: str, order, width: float, process: float = 0.01, primary_var: float = 0.05, secondary_var: float = 0.05) -> DataFrame:
    """Kalman fusion of two sensors: fused, variance and status (fused, primary_only, secondary_only, missing) of every row.

    The variance starts at 1, grows by ``process`` each row and shrinks with each
    sensor; the state starts at the unit's first measurement, before which it is NULL.
    """
    p, s = F.col(primary).isNotNull(), F.col(secondary).isNotNull()
    first = F.coalesce(primary, secondary)
    starts = df.where(first.isNotNull()).groupBy(*keys).agg(F.min_by(first, F.struct(*order)).alias("_first"), F.min(F.struct(*order)).alias("_since"))
    d = matched(df, starts, keys, "left").withColumn("_one", F.lit(1.0))
    one, r1, r2, q = F.lit(1.0), F.lit(primary_var), F.lit(secondary_var), F.lit(process)
    # adding q, then v -> r v / (v + r) for each sensor that is there
    a, b, c, e = one, q, F.lit(0.0), one
    a, b, c, e = F.when(p, r1 * a).otherwise(a), F.when(p, r1 * b).otherwise(b), F.when(p, a + r1 * c).otherwise(c), F.when(p, b + r1 * e).otherwise(e)
    a, b, c, e = F.when(s, r2 * a).otherwise(a), F.when(s, r2 * b).otherwise(b), F.when(s, a + r2 * c).otherwise(c), F.when(s, b + r2 * e).otherwise(e)
    d = recur(d, keys, order, width, (a, b, c, e), "_one", "variance")
    v = F.col("variance_before") + q
    k1 = F.when(p, v / (v + r1)).otherwise(0.0)
    v = (1 - k1) * v
    k2 = F.when(s, v / (v + r2)).otherwise(0.0)
    gain, add = (1 - k1) * (1 - k2), (1 - k2) * k1 * F.coalesce(primary, F.lit(0.0)) + k2 * F.coalesce(secondary, F.lit(0.0))
    d = recur(d, keys, order, width, (gain, add, F.lit(0.0), one), "_first", "fused")
    status = F.when(p & s, "fused").when(p, "primary_only").when(s, "secondary_only").otherwise("missing")
    d = d.withColumn("fused", F.when(F.struct(*order) >= F.col("_since"), F.col("fused"))).withColumn("status", status)
    return d.drop("_one", "_first", "_since", "variance_before", "fused_before")


def adaptive_ema(df: DataFrame, keys, x: str, order, width: float, alpha: float = 0.1, fence: float = 1.5) -> DataFrame:
    """Exponentially weighted centre at every row; samples outside the IQR fences do not move it. NULL before the first one inside."""
    q = df.groupBy(*keys).agg(quantile(x, 0.25).alias("_q1"), quantile(x, 0.75).alias("_q3"))
    spread = F.col("_q3") - F.col("_q1")
    d = matched(df, q, keys, "left").withColumn("outlier", ~F.col(x).between(F.col("_q1") - fence * spread, F.col("_q3") + fence * spread))
    inside = F.col(x).isNotNull() & ~F.col("outlier")
    starts = d.where(inside).groupBy(*keys).agg(F.min_by(x, F.struct(*order)).cast("double").alias("_first"), F.min(F.struct(*order)).alias("_since"))
    d = matched(d, starts, keys, "left")
    one = F.lit(1.0)
    d = recur(d, keys, order, width, (F.when(inside, 1 - alpha).otherwise(1.0), F.when(inside, alpha * F.col(x)).otherwise(0.0), F.lit(0.0), one), "_first", "ema")
    return d.withColumn("ema", F.when(F.struct(*order) >= F.col("_since"), F.col("ema"))).drop("_q1", "_q3", "_first", "_since", "ema_before")


def _states(kept, add, m: np.ndarray, start=None):
    """``kept`` and the states after and before each row of s -> m s + ``add``, each group from its ``start`` or at rest; groups may go on from batch to batch."""

    def run(batches):
        carry = np.zeros(2)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            here = np.arange(n)
            at = here - np.maximum.accumulate(np.where(batch.column("_row").to_numpy() == 1, here, 0))
            v = np.column_stack([column(c) for c in start]) if start else np.zeros((n, 2))
            if batch.column("_row")[0].as_py() > 1:
                v[0] = carry
            s = np.zeros((n, 2))
            for k, c in enumerate(add):
                s[:, k] = column(c)
            opens = at == 0
            s[opens] += v[opens] @ m.T
            power, reach = m, 1
            while reach <= at.max():
                k = np.flatnonzero(at >= reach)
                s[k] += s[k - reach] @ power.T
                power, reach = power @ power, 2 * reach
            before = np.where(opens[:, None], v, np.concatenate([v[:1], s[:-1]]))
            carry = s[-1].copy()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, (s[:, 0].copy(), s[:, 1].copy(), before[:, 0].copy(), before[:, 1].copy()))], names=[*kept, *"_0 _1 _2 _3".split()])

    return run


def second_order(df: DataFrame, keys, order, x: str, feedback: tuple[float, float], forward: tuple[float, float, float], name: str, size: int = 1024) -> DataFrame:
    """Adds ``name``: y = forward . (x, x before, x two before) - feedback . (y before, y two before), in doubles.

    ``x`` must have no NULL; each unit's first value of it is taken to have stood
    for ever before. Rows get their place by ranges. Blocks of ``size`` rows each
    give the state they end with when entered at rest; these few states of a
    unit are chained, and every block runs from its own entry state.
    """
    a = np.array([[-feedback[0], -feedback[1]], [1.0, 0.0]])
    parts = [f"_k{k}" for k in range(len(keys))]
    w = ordered(keys, order)
    d = df.withColumn("_first", F.first(x).over(ordered(keys, order, BEFORE, 0))).withColumn("_u", F.col(x) - F.col("_first"))
    d = d.withColumn("_g", sum(f * F.coalesce(F.lag("_u", k).over(w) if k else F.col("_u"), F.lit(0.0)) for k, f in enumerate(forward)))
    d = running(d.select(*df.columns, "_first", "_g", *[F.col(k).alias(p) for k, p in zip(keys, parts)]), parts, order, place=F.lit(1).cast("long"))
    d = d.withColumn("_block", F.floor(F.col("place_before") / size)).withColumn("_row", F.col("place_before") % size + 1)
    block = [*parts, "_block"]
    fields = lambda of, *names: StructType([*of, *[StructField(n, DoubleType()) for n in names]])
    line = lambda rows, by: (rows.repartition(*by) if by else rows.coalesce(1)).sortWithinPartitions(*by, "_row")
    named = [d.schema[k] for k in block]
    # only the last block may be short, and nothing follows it
    ends = line(d.select(*block, "_row", "_g"), block).mapInArrow(_states([*block, "_row"], ["_g"], a), fields([*named, d.schema["_row"]], "_y1", "_y2", "_b1", "_b2")).where(F.col("_row") == size)
    starts = d.where("_row = 1").select(*block)
    blocks = matched(starts, ends.select(*block, "_y1", "_y2"), block, "left").withColumn("_row", F.col("_block") + 1).fillna(0.0, ["_y1", "_y2"])
    entry = line(blocks, parts).mapInArrow(_states(block, ["_y1", "_y2"], np.linalg.matrix_power(a, size)), fields(named, "_a1", "_a2", "_e1", "_e2")).drop("_a1", "_a2")
    rows = line(matched(d, entry, block), block)
    kept = [*df.columns, "_first"]
    y = rows.mapInArrow(_states(kept, ["_g"], a, ["_e1", "_e2"]), fields([d.schema[c] for c in kept], "_y", "_y2", "_b1", "_b2"))
    return y.select(*df.columns, (F.col("_first") + F.col("_y")).alias(name))


def refractory(df: DataFrame, keys, t: str, distance: float) -> DataFrame:
    """Times kept in order when each must be ``distance`` after the last kept one.

    An event that follows the one before it by ``distance`` is always kept, so the
    stretches between such events are folded apart from each other.
    """
    w = ordered(keys, [t])
    far = F.coalesce(F.col(t) - F.lag(t).over(w) >= distance, F.lit(False))
    d = df.where(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias(t), far.alias("_far")).withColumn("_stretch", F.sum(F.col("_far").cast("long")).over(ordered(keys, [t], BEFORE, 0)))
    one = d.groupBy(*keys, "_stretch").agg(F.sort_array(F.collect_list(t)).alias("s"))
    none = F.lit(None).cast("array<double>")
    step = lambda acc, v: F.when(acc.isNull(), F.array(v)).when(v - F.element_at(acc, -1) >= distance, F.concat(acc, F.array(v))).otherwise(acc)
    return one.select(*keys, F.explode(F.aggregate("s", none, step)).alias(t))
