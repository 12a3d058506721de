"""Agreement of a device with a reference by strata, with participant-cluster bootstrap intervals.

Rows are read once, into moments of each participant. A bootstrap round draws as
many participants as there are, with replacement; its statistics are sums of the
drawn participants' moments, so a round costs participants, not rows. Draws come
from an MD5 of (seed, round, slot, stratum): reruns and other engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import finite
from ..functions.ranges import matched, running
from .stats import _hashed

# Upper category above each typology angle, in degrees.
ANGLES = ((55, "very_light"), (41, "light"), (28, "intermediate"), (10, "tan"), (-30, "brown"))
#: Sums of one row; every statistic is a function of their totals.
MOMENTS = ("rows", "refs", "n", "d", "dd", "ad", "r", "c", "rr", "cc", "rc")


def skin_category(angle: str) -> Column:
    """Category of an individual typology angle; NULL stays NULL."""
    v = F.col(angle)
    out = F.when(v.isNull(), F.lit(None))
    for least, name in ANGLES:
        out = out.when(v > least, name)
    return out.otherwise("dark")


def agreement_moments(df: DataFrame, keys, reference: str, candidate: str) -> DataFrame:
    r, c = finite(F.col(reference).cast("double")), finite(F.col(candidate).cast("double"))
    d = df.select(*keys, r.alias("_r"), c.alias("_c")).withColumn("_ok", F.col("_r").isNotNull() & F.col("_c").isNotNull())
    pair = lambda e: F.coalesce(F.sum(F.when(F.col("_ok"), e)), F.lit(0.0))
    x, y = F.col("_r"), F.col("_c")
    sums = {"rows": F.count("*"), "refs": F.count("_r"), "n": F.count_if("_ok"), "d": pair(y - x), "dd": pair((y - x) * (y - x)), "ad": pair(F.abs(y - x)),
            "r": pair(x), "c": pair(y), "rr": pair(x * x), "cc": pair(y * y), "rc": pair(x * y)}
    return d.groupBy(*keys).agg(*[e.alias(n) for n, e in sums.items()])


def agreement_statistics() -> dict[str, Column]:
    """Retention, bias, MAE, RMSE, limits of agreement and Lin's concordance from total moments; NULL where undefined."""
    m = {k: F.col(k).cast("double") for k in MOMENTS}
    n = F.nullif(m["n"], F.lit(0.0))
    free = F.nullif(n - 1, F.lit(0.0))
    bias = m["d"] / n
    sd = F.sqrt(F.greatest(m["dd"] - m["d"] * m["d"] / n, F.lit(0.0)) / free)
    spread = (m["rr"] - m["r"] * m["r"] / n + m["cc"] - m["c"] * m["c"] / n) / free + F.pow((m["r"] - m["c"]) / n, F.lit(2))
    return {"retention_rate": m["n"] / F.nullif(m["refs"], F.lit(0.0)), "bias": bias, "mae": m["ad"] / n, "rmse": F.sqrt(m["dd"] / n), "loa_lower": bias - 1.96 * sd, "loa_upper": bias + 1.96 * sd,
            "lin_ccc": F.when(spread > 0, 2 * (m["rc"] - m["r"] * m["c"] / n) / free / spread)}


def _rounds(moments: DataFrame, strata, participant: str, sums, rounds: int, seed: int) -> DataFrame:
    """(strata, _round, sums): totals of each bootstrap round; none for strata of one participant."""
    c = running(moments.where(F.col(participant).isNotNull()), strata, [participant], _slot=F.lit(1).cast("long"))
    c = c.select(*strata, F.col("_slot_before").alias("_slot"), F.col("_slot_total").alias("_of"), *sums)
    # dealt over all tasks, by a number that small rows do not lower, before a participant becomes a row a round
    tasks = int(moments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = c.where("_of >= 2").select(*strata, "_slot", "_of").repartition(tasks, *strata, "_slot").withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    draws = draws.select(*strata, "_round", (_hashed(seed, F.col("_round"), F.col("_slot"), *map(F.col, strata)) % F.col("_of")).alias("_slot"))
    # explode does not raise the size that Spark expects, so it would send all draws to every executor
    hit = matched(draws.hint("merge"), c.select(*strata, "_slot", *sums), [*strata, "_slot"])
    return hit.groupBy(*strata, "_round").agg(*[F.sum(s).alias(s) for s in sums])


def intervals(moments: DataFrame, strata, participant: str, sums, statistics: Callable[[], dict[str, Column]], rounds: int, seed: int = 1) -> DataFrame:
    """(strata, metric, estimate, ci_low, ci_high): estimates from all rows and 95% percentile bounds over rounds of whole participants."""
    strata = list(strata)
    long = lambda df, name: df.select(*df.columns[: len(strata)], F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias(name)) for k, v in statistics().items()])).alias("_s")).select(*strata, "_s.*")
    point = long(moments.groupBy(*strata).agg(*[F.sum(s).alias(s) for s in sums]), "estimate")
    boot = long(_rounds(moments, strata, participant, sums, rounds, seed), "_v").groupBy(*strata, "metric").agg(
        F.percentile("_v", F.lit(0.025)).alias("ci_low"), F.percentile("_v", F.lit(0.975)).alias("ci_high"))
    return matched(point, boot, [*strata, "metric"], "left")


def agreement_intervals(df: DataFrame, strata, participant: str, reference: str, candidate: str, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """Agreement of each stratum with participant-cluster bounds."""
    m = agreement_moments(df, [*strata, participant], reference, candidate)
    return intervals(m, strata, participant, MOMENTS, agreement_statistics, rounds, seed)


def agreement_by_category(df: DataFrame, strata, angle: str, participant: str, reference: str, candidate: str) -> DataFrame:
    """Agreement by stratum and skin category, with rows, participants and pairs."""
    keys = [*strata, "pigmentation_category"]
    d = df.withColumn("pigmentation_category", skin_category(angle))
    m = agreement_moments(d, [*keys, participant], reference, candidate)
    s = m.groupBy(*keys).agg(F.count(participant).alias("n_participants"), *[F.sum(c).alias(c) for c in MOMENTS])
    return s.select(*keys, F.col("rows").alias("n_rows"), "n_participants", F.col("refs").alias("reference_available"), F.col("n").alias("n_pairs"), *[e.alias(k) for k, e in agreement_statistics().items()])


def error_slopes(df: DataFrame, participant: str, x: str, reference: str, candidate: str, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(metric, estimate, ci_low, ci_high, n_rows, n_clusters): slopes of the signed and the absolute error on ``x``, such as the typology angle."""
    e = finite(F.col(candidate).cast("double")) - finite(F.col(reference).cast("double"))
    d = df.select(F.col(participant).alias("_who"), finite(F.col(x).cast("double")).alias("_x"), e.alias("_e")).where("_who is not null and _x is not null and _e is not null")
    a, b = F.col("_x"), F.col("_e")
    sums = {"n": F.count("*"), "x": F.sum(a), "xx": F.sum(a * a), "e": F.sum(b), "xe": F.sum(a * b), "a": F.sum(F.abs(b)), "xa": F.sum(a * F.abs(b))}
    m = d.groupBy("_who").agg(*[v.alias(k) for k, v in sums.items()])

    def slopes() -> dict[str, Column]:
        n, sxx = F.col("n").cast("double"), F.col("xx") - F.col("x") * F.col("x") / F.col("n")
        slope = lambda y: F.when((n >= 3) & (sxx > 1e-12 * F.col("xx")), (F.col("x" + y) - F.col("x") * F.col(y) / n) / sxx)
        return {"signed_error": slope("e"), "absolute_error": slope("a")}

    size = m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_clusters"))
    return intervals(m, [], "_who", list(sums), slopes, rounds, seed).join(F.broadcast(size))  # one row
