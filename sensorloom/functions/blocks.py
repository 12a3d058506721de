"""Windows of bounded reach over long groups, side by side in blocks with copies of the rows at their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranges import matched

BLOCK = "_block"
HOME = "_home"


def in_blocks(df: DataFrame, at, width: float, reach: float) -> DataFrame:
    """Rows by stretches of ``width`` of ``at``: those within ``reach`` of a border are copied over it, with ``_home`` false.

    A window by (keys, ``_block``) then sees all rows within ``reach`` of each row
    of its own; keep the ``_home`` rows after it.
    """
    at = F.col(at) if isinstance(at, str) else at
    of = lambda v: F.floor(v / width).cast("long")
    d = df.withColumn("_own", of(at)).withColumn(BLOCK, F.explode(F.sequence(of(at - reach), of(at + reach))))
    return d.withColumn(HOME, F.col(BLOCK) == F.col("_own")).drop("_own")


def home(df: DataFrame) -> DataFrame:
    return df.where(HOME).drop(BLOCK, HOME)


def near(keys, order: str, start: int, stop: int) -> Window:
    """The rows of one block from ``start`` to ``stop`` rows away."""
    return Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(start, stop)


def within(value: str, keys, order: str, reach: float) -> Column:
    """The aggregate ``value`` (SQL) over the rows of one block within ``reach`` of the double ``order``."""
    by = ", ".join(f"`{k}`" for k in (*keys, BLOCK))
    return F.expr(f"{value} over (partition by {by} order by `{order}` range between {reach!r}D preceding and {reach!r}D following)")


def carried(df: DataFrame, keys, at: str, value: Column, width: int, name: str) -> DataFrame:
    """Adds ``name``, the last ``value`` that is not NULL at or before each row in the order of ``at``.

    Each block looks at its own rows; what came before it is taken from a table of one row a block.
    """
    d = df.withColumn("_carry", value).withColumn(BLOCK, F.floor(F.col(at) / width).cast("long"))
    ends = d.groupBy(*keys, BLOCK).agg(F.max_by("_carry", F.when(F.col("_carry").isNotNull(), F.col(at))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(before))
    d = d.withColumn(name, F.last("_carry", ignorenulls=True).over(near(keys, at, Window.unboundedPreceding, 0)))
    return matched(d, ends, [*keys, BLOCK]).withColumn(name, F.coalesce(name, "_end")).drop("_carry", "_end", BLOCK)


def boundaries(df: DataFrame, keys, at: str, flag: Column, width: int) -> DataFrame:
    """(keys, lo, hi): the runs of rows where ``flag`` holds; ``at`` counts each group's rows from 0.

    Rows are looked at in blocks; only the first and last row of each run are put in order.
    """
    w = Window.partitionBy(*keys, BLOCK).orderBy(at)
    d = in_blocks(df.select(*keys, at, F.coalesce(flag, F.lit(False)).alias("_f")), at, width, 1)
    d = home(d.withColumn("_p", F.coalesce(F.lag("_f").over(w), F.lit(False))).withColumn("_n", F.coalesce(F.lead("_f").over(w), F.lit(False)))).where("_f and not (_p and _n)")
    ends = F.explode(F.array_compact(F.array(F.when(~F.col("_p"), F.lit(0)), F.when(~F.col("_n"), F.lit(1)))))
    d = d.select(*keys, F.col(at).alias("lo"), ends.alias("_kind"))
    return d.withColumn("hi", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo", "_kind"))).where("_kind = 0").drop("_kind")


def merged(intervals: DataFrame, keys, gap: int = 0) -> DataFrame:
    """(keys, lo, hi): intervals joined where at most ``gap`` places lie between them."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    d = intervals.select(*keys, "lo", "hi").withColumn("_far", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", (F.col("_far").isNull() | (F.col("lo") > F.col("_far") + 1 + gap)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def covering(df: DataFrame, keys, at: str, intervals: dict[str, DataFrame], width: int) -> DataFrame:
    """Adds for each name the interval (a struct of its columns beside the keys) that holds the row, or NULL.

    The intervals of one name do not overlap. They are cut at block borders and
    meet the rows of a block in one pass in order.
    """
    parts = df.withColumn(BLOCK, F.floor(F.col(at) / width).cast("long")).withColumn("_row", F.lit(1))
    for name, i in intervals.items():
        whole = F.struct(*[F.col(c) for c in i.columns if c not in keys]).alias(f"_i_{name}")
        cut = i.select(*keys, whole, F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))).alias(BLOCK))
        cut = cut.withColumn(at, F.greatest(F.col(f"_i_{name}.lo"), F.col(BLOCK) * width)).withColumn("_row", F.lit(0))
        parts = parts.unionByName(cut, allowMissingColumns=True)
    w = Window.partitionBy(*keys, BLOCK).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    for name in intervals:
        held = F.last(f"_i_{name}", ignorenulls=True).over(w)
        parts = parts.withColumn(f"_i_{name}", held)
    parts = parts.where("_row = 1")
    for name in intervals:
        parts = parts.withColumn(name, F.when(F.col(f"_i_{name}.hi") >= F.col(at), F.col(f"_i_{name}"))).drop(f"_i_{name}")
    return parts.drop(BLOCK, "_row")
