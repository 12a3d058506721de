"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(x) -> Column:
    """NaN and infinities become NULL, the one missing value."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def median(x) -> Column:
    """Exact median with linear interpolation."""
    return F.percentile(x, F.lit(0.5))


def quantile(x, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def correlation(x, y) -> Column:
    """Pearson's r of the complete pairs, NULL where either side is constant (``F.corr`` fails there under ANSI rules)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def robust(df: DataFrame, keys, x: str, centre: str, spread: str, scale: float = 1.4826) -> DataFrame:
    """Adds the group's median of ``x`` and its scaled median absolute deviation, by windows over one partitioning."""
    w = whole(keys)
    return df.withColumn(centre, median(x).over(w)).withColumn(spread, scale * median(F.abs(F.col(x) - F.col(centre))).over(w))


def ordered(keys, order, *frame) -> Window:
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(*frame) if frame else w


def whole(keys) -> Window:
    return Window.partitionBy(*keys)


BEFORE, AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def last_known(x, keys, order, upto: int = 0) -> Column:
    return F.last(x, ignorenulls=True).over(ordered(keys, order, BEFORE, upto))


def next_known(x, keys, order, start: int = 0) -> Column:
    return F.first(x, ignorenulls=True).over(ordered(keys, order, start, AFTER))


def islands(df: DataFrame, flag: Column, keys, order, name: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal ``flag`` within each group, from 1."""
    w = ordered(keys, order)
    changed = F.coalesce((~flag.eqNullSafe(F.lag(flag).over(w))).cast("long"), F.lit(1))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", F.when(first, 1).otherwise(changed)).withColumn(name, F.sum("_new").over(ordered(keys, order, BEFORE, 0))).drop("_new")


def reasons(*pairs: tuple[str, Column], sep: str = ";") -> Column:
    """The names whose conditions hold, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs])), sep)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
