"""Streams of several devices on one clock: offsets, lags, dejitter, and a nearest merge of all in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.blocks import BLOCK, HOME, in_blocks
from ..functions.core import union_all
from ..functions.ranges import matched, running

RAW, TIME, RELATIVE = "raw_s", "corrected_s", "relative_s"


@dataclass
class Stream:
    """A table with its time column (seconds), the columns to carry, and what its clock is off by; ``order`` tells rows of one time apart."""

    data: DataFrame
    time: str
    columns: list[str]
    order: list[str]
    offset: float = 0.0
    lag: float = 0.0
    rate: float | None = None


def corrected(s: Stream, keys, dejitter: bool = False) -> DataFrame:
    """The stream with raw_s and corrected_s = raw + offset - lag; dejittered times run from the first one at the nominal rate."""
    keys = list(keys)
    d = s.data.withColumn(RAW, F.col(s.time).cast("double")).withColumn(TIME, F.col(RAW) + s.offset - s.lag)
    if not dejitter:
        return d
    if not s.rate or s.rate <= 0:
        raise ValueError("dejittering takes a nominal rate")
    d = running(d, keys, s.order, _k=F.lit(1).cast("long"))
    start = d.where("_k_before = 0").select(*keys, F.col(TIME).alias("_start"))
    return matched(d, start, keys).withColumn(TIME, F.col("_start") + F.col("_k_before") / s.rate).drop("_start", "_k_before", "_k_total")


def synchronised(streams: dict[str, Stream], keys, reference: str, zero: str = "reference", dejitter: bool = False) -> dict[str, DataFrame]:
    """Every stream with relative_s: its corrected time since the first row of the reference, of any stream ('global'), or as it is ('none')."""
    keys = list(keys)
    out = {n: corrected(s, keys, dejitter) for n, s in streams.items()}
    if zero == "none":
        return {n: d.withColumn(RELATIVE, F.col(TIME)) for n, d in out.items()}
    starts = [out[n].groupBy(*keys).agg(F.min_by(TIME, F.struct(*streams[n].order)).alias("_zero")) for n in ([reference] if zero == "reference" else streams)]
    start = union_all(starts).groupBy(*keys).agg(F.min("_zero").alias("_zero"))
    return {n: matched(d, start, keys, "left").withColumn(RELATIVE, F.col(TIME) - F.col("_zero")).drop("_zero") for n, d in out.items()}


def merge_nearest(streams: dict[str, Stream], keys, reference: str, tolerance: float | None = None, zero: str = "reference", dejitter: bool = False) -> DataFrame:
    """Rows of the reference with ``<stream>__<column>`` of the nearest row of every other stream, and ``<stream>__time_difference_s``.

    All streams lie in one union; one pass in time order knows the last and the
    next row of each. The earlier of two equally near rows is taken, the first of
    rows of one time; beyond ``tolerance`` there is none. With a tolerance,
    stretches of time run side by side; without one a row may be any time away, so
    a recording is one task's sort.
    """
    keys = list(keys)
    sync = synchronised(streams, keys, reference, zero, dejitter)
    others = [n for n in streams if n != reference]
    own = streams[reference]
    base = sync[reference].select(*keys, F.col(RELATIVE).alias("_t"), F.struct(*dict.fromkeys([*own.order, *own.columns]), RAW, TIME).alias("_ref"))
    frames = [base.where("_t is not null")]
    for n in others:
        s = streams[n]
        one = sync[n].where(F.col(RELATIVE).isNotNull()).groupBy(*keys, F.col(RELATIVE).alias("_t")).agg(F.min_by(F.struct(*s.columns), F.struct(*s.order)).alias("_v"))
        frames.append(one.select(*keys, "_t", F.struct("_t", "_v").alias(f"_s_{n}")))
    u = union_all(frames)
    by = keys
    if tolerance is not None:
        u = in_blocks(u, "_t", max(64 * tolerance, 1e-9), tolerance)
        by = [*keys, BLOCK]
    w = Window.partitionBy(*by).orderBy("_t")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    seen = {f"_{k}_{n}": f(f"_s_{n}", ignorenulls=True).over(x) for n in others for k, f, x in (("a", F.last, before), ("b", F.first, after))}
    u = u.withColumns(seen).where(F.col("_ref").isNotNull())
    if tolerance is not None:
        u = u.where(HOME)

    def nearest(n: str) -> Column:
        a, b = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        back = b.isNull() | (F.col("_t") - a["_t"] <= b["_t"] - F.col("_t"))
        got = F.when(back, a).otherwise(b)
        return got if tolerance is None else F.when(F.abs(got["_t"] - F.col("_t")) <= tolerance, got)

    u = u.withColumns({f"_n_{n}": nearest(n) for n in others})
    cells = [F.col(f"_n_{n}._v.{c}").alias(f"{n}__{c}") for n in others for c in streams[n].columns]
    gaps = [(F.col(f"_n_{n}._t") - F.col("_t")).alias(f"{n}__time_difference_s") for n in others]
    return u.select(*keys, "_ref.*", F.col("_t").alias(RELATIVE), *cells, *gaps)


def stream_audit(streams: dict[str, Stream]) -> DataFrame:
    """A row a stream: samples, offset and lag."""
    return union_all([s.data.agg(F.count("*").alias("n_samples")).select(F.lit(n).alias("stream"), "n_samples", F.lit(float(s.offset)).alias("clock_offset_s"), F.lit(float(s.lag)).alias("known_lag_s")) for n, s in streams.items()])
