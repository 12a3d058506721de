"""Statistics over grids, resampling, agreement, model tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import islands, ordered, whole

# The cumulative probabilities of a Poisson distribution of mean 1, from 0 on.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def _hashed(seed: int, *columns: Column) -> Column:
    """An unsigned 32-bit number from an MD5, as any engine gives it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def agreement(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Lin's concordance, Bland-Altman bias and limits, mean absolute and root mean square difference."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b))
    s = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        F.covar_samp(a, b).alias("_c"), F.var_samp(a).alias("_a"), F.var_samp(b).alias("_b"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"))
    ccc = F.try_divide(2 * F.col("_c"), F.col("_a") + F.col("_b") + F.pow(F.col("_ma") - F.col("_mb"), F.lit(2)))
    return s.withColumn("ccc", ccc).withColumn("low", F.col("bias") - 1.96 * F.col("sd")).withColumn("high", F.col("bias") + 1.96 * F.col("sd")).drop("_c", "_a", "_b", "_ma", "_mb")


def responsivity(df: DataFrame, unit: str, response, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """Beta-binomial posterior of each unit's response rate."""
    d = df.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(response).alias("k"))
    p, q = F.col("k") + a, F.col("n") - F.col("k") + b
    return d.withColumn("posterior_mean", p / (p + q)).withColumn("posterior_sd", F.sqrt(p * q / ((p + q) * (p + q) * (p + q + 1))))


def paired_t_by_time(df: DataFrame, subject: str, condition: str, time: str, x: str, levels: tuple[str, str]) -> DataFrame:
    """Paired t at each time; a zero SD gives 0. Cells of a subject and condition are averaged first."""
    a, b = levels
    cell = df.where(F.col(condition).isin(a, b)).groupBy(subject, time).agg(F.avg(F.when(F.col(condition) == a, F.col(x))).alias("a"), F.avg(F.when(F.col(condition) == b, F.col(x))).alias("b"))
    d = cell.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.col("b") - F.col("a"))
    t = d.groupBy(time).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return t.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0))


def time_clusters(tmap: DataFrame, time: str, limit: float) -> DataFrame:
    """Runs of neighbouring times of one sign beyond the limit, with their summed t. One row a time bin is ordered."""
    sign = F.when(F.col("t") > limit, 1).when(F.col("t") < -limit, -1).otherwise(0)
    d = islands(tmap.withColumn("sign", sign), F.col("sign"), [], [time])
    return d.where("sign <> 0").groupBy("run", "sign").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("size"), F.sum("t").alias("mass")).drop("run")


def threshold_sensitivity(tmap: DataFrame, time: str, limits) -> DataFrame:
    """Number of clusters and the largest mass at each threshold."""
    d = tmap.withColumn("limit_t", F.explode(F.array(*[F.lit(float(v)) for v in limits])))
    sign = F.when(F.col("t") > F.col("limit_t"), 1).when(F.col("t") < -F.col("limit_t"), -1).otherwise(0)
    r = islands(d.withColumn("sign", sign), F.col("sign"), ["limit_t"], [time]).groupBy("limit_t", "run", "sign").agg(F.abs(F.sum("t")).alias("mass"))
    mass = F.when(F.col("sign") != 0, F.col("mass"))
    return r.groupBy("limit_t").agg(F.count(mass).alias("clusters"), F.coalesce(F.max(mass), F.lit(0.0)).alias("largest"))


def cluster_null(df: DataFrame, subject: str, condition: str, time: str, x: str, levels: tuple[str, str], limit: float, rounds: int, seed: int = 1) -> DataFrame:
    """Largest cluster mass of each sign-flip round: subjects' differences change sign by an MD5 of (seed, round, subject)."""
    a, b = levels
    cell = df.where(F.col(condition).isin(a, b)).groupBy(subject, time).agg((F.avg(F.when(F.col(condition) == b, F.col(x))) - F.avg(F.when(F.col(condition) == a, F.col(x)))).alias("d")).where("d is not null")
    flips = cell.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    d = flips.withColumn("d", F.col("d") * (1 - 2 * (_hashed(seed, F.col("round"), F.col(subject)) % 2)))
    t = d.groupBy("round", time).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("*").alias("n")).withColumn("t", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(0.0))
    sign = F.when(F.col("t") > limit, 1).when(F.col("t") < -limit, -1).otherwise(0)
    r = islands(t.withColumn("sign", sign), F.col("sign"), ["round"], [time]).where("sign <> 0").groupBy("round", "run").agg(F.abs(F.sum("t")).alias("mass"))
    return d.select("round").distinct().join(r.groupBy("round").agg(F.max("mass").alias("mass")), "round", "left").fillna(0.0, ["mass"])


def bootstrap_difference(df: DataFrame, keys, condition: str, x: str, levels: tuple[str, str], rounds: int, row: str, seed: int = 1) -> DataFrame:
    """Mean difference of two conditions with Poisson-bootstrap percentile bounds; weights come from an MD5 of (seed, round, row), so reruns agree.

    ``row`` names each row. Rows are dealt over all tasks and meet their rounds in a map-side aggregation; only a sum for each key and round is shuffled.
    """
    a, b = levels
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.where(F.col(condition).isin(a, b) & F.col(x).isNotNull()).select(*dict.fromkeys([*keys, condition, x, row])).repartition(tasks, row).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    # eight hexadecimal digits, as a fraction of 2^32, lie in the order of their text
    d = d.withColumn("_u", F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col(row).cast("string"))), 1, 8))
    weight = F.when(F.col("round") == 0, 1)
    for k, p in enumerate(POISSON):
        weight = weight.when(F.col("_u") < f"{math.ceil(p * 2**32):08x}", k)
    d = d.withColumn("w", weight.otherwise(len(POISSON)))
    mean = lambda c: F.try_divide(F.sum(F.when(F.col(condition) == c, F.col("w") * F.col(x))), F.sum(F.when(F.col(condition) == c, F.col("w"))))
    r = d.groupBy(*keys, "round").agg((mean(b) - mean(a)).alias("diff"))
    boot = F.when(F.col("round") > 0, F.col("diff"))
    return r.groupBy(*keys).agg(F.max(F.when(F.col("round") == 0, F.col("diff"))).alias("diff"), F.percentile(boot, F.lit(0.025)).alias("low"), F.percentile(boot, F.lit(0.975)).alias("high"),
                                F.least(F.lit(1.0), 2 * F.least(F.count_if(boot <= 0), F.count_if(boot >= 0)) / F.count(boot)).alias("p"))


def multiverse(df: DataFrame, keys, x: str, rel: str, windows, thresholds) -> DataFrame:
    """Every response window by threshold: peak minus mean baseline per group, and whether it is a response."""
    spec = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"), F.lit(float(c)).alias("threshold")) for a, b in windows for c in thresholds]))
    d = df.withColumn("spec", spec).select(*keys, x, rel, "spec.*")
    inside = F.col(rel).between(F.col("lo"), F.col("hi"))
    g = d.groupBy(*keys, "lo", "hi", "threshold").agg((F.max(F.when(inside, F.col(x))) - F.coalesce(F.avg(F.when(F.col(rel) < 0, F.col(x))), F.lit(0.0))).alias("amplitude"))
    return g.withColumn("present", F.coalesce(F.col("amplitude") >= F.col("threshold"), F.lit(False)))


def mixed_model_table(df: DataFrame, outcome: str, numeric, factors) -> DataFrame:
    """Rows with an outcome; numeric columns centred and scaled by one aggregation, factors as strings."""
    d = df.where(F.col(outcome).isNotNull())
    s = d.agg(*[f(c).alias(f"_{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_samp))])  # one row
    out = d.join(F.broadcast(s))
    return out.select(*[c for c in df.columns if c not in factors], *[F.col(c).cast("string").alias(c) for c in factors], *[F.try_divide(F.col(c) - F.col("_m_" + c), F.col("_s_" + c)).alias(c + "_z") for c in numeric])


def hurdle_table(df: DataFrame, keys, amplitude: str, threshold: float) -> DataFrame:
    """Binary response and, where there is one, log amplitude."""
    r = F.col(amplitude) >= threshold
    return df.select(*keys, F.coalesce(r, F.lit(False)).cast("int").alias("response"), F.when(r, F.ln(amplitude)).alias("log_amplitude"))


def design_scores(candidates: DataFrame, done: DataFrame, condition: str, utility: str, weight: float, balance: float) -> DataFrame:
    """Next-trial score: utility, a bonus for unseen conditions, a penalty for frequent ones; best first."""
    n = done.groupBy(condition).agg(F.count("*").alias("n_done"))
    d = candidates.join(n, condition, "left").fillna(0, ["n_done"])  # one row a condition
    most = F.greatest(F.max("n_done").over(whole([])), F.lit(1))
    d = d.withColumn("score", F.col(utility) + weight / (F.col("n_done") + 1) - balance * F.col("n_done") / most)
    return d.withColumn("rank", F.row_number().over(ordered([], [F.desc("score"), condition])))


def one_way_f(df: DataFrame, keys, group: str, x: str) -> DataFrame:
    """One-way analysis of variance: F and its degrees of freedom from group aggregates."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    s = g.groupBy(*keys).agg(F.count("*").alias("_k"), F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("_q") - F.col("total") * F.col("grand") * F.col("grand")
    return s.select(*keys, (F.col("_k") - 1).alias("df_between"), (F.col("total") - F.col("_k")).alias("df_within"),
                    F.try_divide(F.try_divide(between, F.col("_k") - 1), F.try_divide(F.col("within"), F.col("total") - F.col("_k"))).alias("f"))


def kruskal(df: DataFrame, keys, group: str, x: str) -> DataFrame:
    """Kruskal-Wallis H on mean ranks within each key, corrected for ties; NULL where all values are equal."""
    d = df.where(F.col(x).isNotNull())
    same = F.count("*").over(whole([*keys, x]))
    d = d.withColumn("_r", F.rank().over(ordered(keys, [x])) + (same - 1) / 2).withColumn("_t", (same * same - 1).cast("double"))
    g = d.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum("_r").alias("r"), F.sum("_t").alias("t"))
    s = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_q"), F.sum("t").alias("_t"))
    n = F.col("n").cast("double")
    ties = 1 - F.try_divide(F.col("_t"), n * n * n - n)
    return s.select(*keys, "n", F.try_divide(12.0 * F.col("_q") / (n * (n + 1)) - 3 * (n + 1), F.nullif(ties, F.lit(0.0))).alias("h"))


def icc_agreement(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """ICC(A,1) of two devices: absolute agreement of single measures."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_m", (F.col(a) + F.col(b)) / 2).withColumn("_d", F.col(a) - F.col(b))
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("_m").alias("_vm"), F.var_samp("_d").alias("_vd"), F.avg("_d").alias("_md"))
    rows, error, columns = 2 * F.col("_vm"), F.col("_vd") / 2, F.col("n") * F.col("_md") * F.col("_md") / 2
    return s.withColumn("icc", F.try_divide(rows - error, rows + error + 2 * (columns - error) / F.col("n"))).drop("_vm", "_vd", "_md")


def wide_means(df: DataFrame, unit: str, column: str, x: str, levels) -> DataFrame:
    """One row a unit with the mean of each level in its own column."""
    return df.groupBy(unit).pivot(column, list(levels)).agg(F.avg(x))
