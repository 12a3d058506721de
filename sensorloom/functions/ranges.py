"""Places and prefix sums of long groups, by ranges of rows instead of one task a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .core import BEFORE


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, as ``spark.checkpoint.dir`` names it: later reads see the same rows in the same partitions."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/sensorloom")
    return df.checkpoint()


def matched(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the keys of ``a`` and all other columns of both."""
    renamed = b.select(*[F.col(k).alias(f"_on_{k}") if k in keys else F.col(k) for k in b.columns])
    on = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys], F.lit(True))
    return a.join(renamed, on, how).drop(*[f"_on_{k}" for k in keys])


def running(df: DataFrame, keys, order, **sums: Column) -> DataFrame:
    """Adds, for each named column, its sum over the group's rows ahead in ``order`` (``name_before``) and over the group (``name_total``).

    Rows are sorted by range, so that a group lies in as many partitions as its
    size asks for. Each adds up its own rows; what lies ahead of it comes from a
    table with one row for each partition and group in it. Rows equal in ``order``
    must be told apart by it, or stand in any order.
    """
    d = df.withColumns({f"_w_{n}": c for n, c in sums.items()}).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    d = kept(d.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    group, rows = Window.partitionBy(*keys), Window.partitionBy(*keys, "_part").orderBy("_id").rowsBetween(BEFORE, -1)
    ahead = d.groupBy(*keys, "_part").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in sums])
    ahead = ahead.select(*keys, "_part", *[e for n in sums for e in (
        (F.sum(f"_s_{n}").over(group.orderBy("_part")) - F.col(f"_s_{n}")).alias(f"_a_{n}"), F.sum(f"_s_{n}").over(group).alias(f"{n}_total"))])
    d = d.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_w_{n}").over(rows), F.lit(0)) for n in sums})
    out = matched(d, ahead, [*keys, "_part"]).withColumns({f"{n}_before": F.col(f"_i_{n}") + F.col(f"_a_{n}") for n in sums})
    return out.drop("_id", "_part", *[f"_{k}_{n}" for n in sums for k in "wia"])
