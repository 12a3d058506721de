"""Time courses of two conditions: their grid, and cluster permutation of two separate groups of participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import finite, islands, median, ordered
from .stats import _hashed


def timecourse_cells(df: DataFrame, subject: str, condition: str, time: str, x: str, levels: tuple[str, str], width: float | None = None, centre: str = "mean") -> DataFrame:
    """(subject, condition, time, value, complete): one mean or median a participant, condition and time bin.

    Rows without a participant, a finite time or a finite value, and rows of
    other conditions, are left out. Bins are ``width`` wide and named by their
    start. ``complete`` says that the participant has a value of both conditions
    at every time that anyone has.
    """
    if centre not in ("mean", "median"):
        raise ValueError("centre is mean or median")
    if width is not None and not width > 0:
        raise ValueError("width must be positive")
    if levels[0] == levels[1]:
        raise ValueError("two different conditions are needed")
    t = finite(F.col(time).cast("double"))
    t = t if width is None else F.floor(t / width) * width
    d = df.select(F.col(subject).alias("subject"), F.col(condition).alias("condition"), t.alias("time"), finite(F.col(x).cast("double")).alias("value"))
    d = d.where(F.col("condition").isin(*levels) & F.col("subject").isNotNull() & F.col("time").isNotNull() & F.col("value").isNotNull())
    cells = d.groupBy("subject", "condition", "time").agg((F.avg("value") if centre == "mean" else median("value")).alias("value"))
    times = cells.agg(F.count_distinct("time").alias("_times"))  # one row
    have = cells.groupBy("subject").agg(F.count("*").alias("_have"))
    out = cells.join(have, "subject").join(F.broadcast(times))
    return out.select("subject", "condition", "time", "value", (F.col("_have") == 2 * F.col("_times")).alias("complete"))


def group_members(cells: DataFrame, levels: tuple[str, str]) -> DataFrame:
    """(subject, first): participants seen in one condition only, and whether it is ``levels[0]``; those seen in both belong to neither group."""
    d = cells.groupBy("subject").agg(F.min("condition").alias("_low"), F.max("condition").alias("_high")).where("_low = _high")
    return d.select("subject", (F.col("_low") == levels[0]).alias("first"))


def _pooled_t(n: Column, s: Column, q: Column, n1: Column, s1: Column) -> Column:
    """Student's t of the first group against the rest from counts and sums; 0 where a group is empty or nothing varies within them."""
    n2, s2 = n - n1, s - s1
    within = q - s1 * s1 / n1 - s2 * s2 / n2
    return F.when((n1 > 0) & (n2 > 0) & (n > 2) & (within > 1e-12 * q), (s1 / n1 - s2 / n2) / F.sqrt(within / (n - 2) * (1 / n1 + 1 / n2))).otherwise(0.0)


def _moments(cells: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the members, centred at each time's mean, and each time's count, sum and sum of squares about it."""
    d = cells.join(members, "subject")
    means = d.groupBy("time").agg(F.avg("value").alias("_mean"))
    d = d.join(means, "time").withColumn("_c", F.col("value") - F.col("_mean"))
    totals = d.groupBy("time").agg(F.count("*").alias("n"), F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    return d, totals


def between_t(cells: DataFrame, levels: tuple[str, str]) -> DataFrame:
    """(time, n_first, n_second, difference, t): Student's t of the two groups at each time, ``levels[0]`` less ``levels[1]``."""
    d, totals = _moments(cells, group_members(cells, levels))
    one = d.where("first").groupBy("time").agg(F.count("*").alias("_n1"), F.sum("_c").alias("_s1"))
    r = totals.join(one, "time", "left").fillna(0, ["_n1", "_s1"])
    n2 = F.col("n") - F.col("_n1")
    difference = F.try_divide(F.col("_s1"), F.col("_n1")) - F.try_divide(F.col("_s") - F.col("_s1"), n2)
    return r.select("time", F.col("_n1").alias("n_first"), n2.alias("n_second"), difference.alias("difference"), _pooled_t(F.col("n"), F.col("_s"), F.col("_q"), F.col("_n1"), F.col("_s1")).alias("t"))


def clusters(tmap: DataFrame, keys, time: str, limit: float, tail: str = "two.sided") -> DataFrame:
    """(keys, direction, start, stop, size, signed_mass, mass): runs of neighbouring times whose t reaches the limit on one side."""
    if tail not in ("two.sided", "positive", "negative"):
        raise ValueError("tail is two.sided, positive or negative")
    up, down = F.lit(tail != "negative") & (F.col("t") >= limit), F.lit(tail != "positive") & (F.col("t") <= -limit)
    d = islands(tmap.withColumn("direction", F.when(up, "positive").when(down, "negative").otherwise("none")), F.col("direction"), keys, [time])
    r = d.where("direction <> 'none'").groupBy(*keys, "run", "direction").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("size"), F.sum("t").alias("signed_mass"))
    return r.withColumn("mass", F.abs("signed_mass")).drop("run")


def between_null(cells: DataFrame, levels: tuple[str, str], limit: float, rounds: int, seed: int = 1, tail: str = "two.sided") -> DataFrame:
    """(round, mass): the largest cluster mass when participants are dealt to the groups anew, group sizes unchanged.

    In every round the first group is the participants of lowest MD5 of (seed,
    round, participant). Counts, sums and squares over all participants do not
    change with the labels, so a round needs only the first group's count and
    sum at each time, which are added up before they are shuffled. Each
    participant carries an array of the rounds that deal it to the first group.
    """
    members = group_members(cells, levels)
    d, totals = _moments(cells, members)
    size = members.agg(F.count_if("first").alias("_first"))  # one row
    dealt = members.select("subject").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    dealt = dealt.withColumn("_place", F.row_number().over(ordered(["round"], [_hashed(seed, F.col("round"), F.col("subject")), "subject"])))
    mine = dealt.join(F.broadcast(size)).where("_place <= _first").groupBy("subject").agg(F.collect_list("round").alias("_rounds"))
    one = d.select("subject", "time", "_c").join(mine, "subject").select("time", "_c", F.explode("_rounds").alias("round")).groupBy("round", "time").agg(F.count("*").alias("_n1"), F.sum("_c").alias("_s1"))
    grid = totals.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    r = grid.join(one, ["round", "time"], "left").fillna(0, ["_n1", "_s1"])
    t = r.select("round", "time", _pooled_t(F.col("n"), F.col("_s"), F.col("_q"), F.col("_n1"), F.col("_s1")).alias("t"))
    largest = clusters(t, ["round"], "time", limit, tail).groupBy("round").agg(F.max("mass").alias("mass"))
    return t.select("round").distinct().join(largest, "round", "left").fillna(0.0, ["mass"])


def cluster_p_values(found: DataFrame, null: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ``p_value``, one more than the rounds whose largest mass is no smaller over one more than all rounds, and ``significant``."""
    levels = null.agg(F.collect_list("mass").alias("_null"))  # one row, a number a round
    at_least = F.size(F.filter("_null", lambda v: v >= F.col("mass")))
    d = found.join(F.broadcast(levels)).withColumn("p_value", (at_least + 1) / (F.size("_null") + 1)).drop("_null")
    return d.withColumn("significant", F.col("p_value") <= alpha)
