"""URL filter: host/path rules, then logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions. The model is fitted on a bounded
sample of rule-labelled addresses (``SAMPLE`` rows); each gradient step is one
aggregation whose result has at most ``DIMS`` rows.

Defined results: a null address or one without ``://`` has an empty host and
path, no rule, and the verdict of the model's bias. Repeated rows are judged
alike. An empty table gives an empty result. If no address fits a rule, or all
that do have one label, the weights are zero and the model allows.
Only ``page_id`` and ``url`` are used; further columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, materialize, read

#: (verdict, host, path), a bounded list: the plan holds one comparison a rule.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SAMPLE, DIMS, STEPS, RATE, RIDGE = 2000, 1024, 15, 4.0, 1e-3


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host (A-Z lower-cased) and path of each row."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (
        pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
        .withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
        .withColumn("path", F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), "^[^?#]*", 0))
        .withColumn("host", F.translate("host", upper, upper.lower()))
        .drop("rest")
    )


def fitting(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def features(dims: int = DIMS) -> Column:
    """Hashed character 3- and 4-grams of host and path; a set, so that length does not rule."""
    whole = F.concat(F.lit("^"), F.col("host"), F.lit("|"), F.col("path"), F.lit("$"))

    def grams(s, n):
        at = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(dims)).cast("int"))

    return let(whole, lambda s: F.array_distinct(F.concat(grams(s, 3), grams(s, 4))))


def logit(x: Column, weights: list[float], bias: float) -> Column:
    """Mean weight of the features, scaled by the root of their number, plus the bias."""
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    return let(x, lambda v: F.aggregate(v, F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1)) / F.sqrt(F.size(v)) + F.lit(bias))


def fit(labelled: DataFrame, dims: int = DIMS, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias from rows (host, path, blocked 0/1); the table must be bounded."""
    rows = materialize(labelled.select(features(dims).alias("x"), F.col("blocked").cast("double").alias("y")))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    weights, bias = [0.0] * dims, 0.0
    if not n or ones in (0, n):
        return weights, bias
    bias = math.log(ones / (n - ones))
    for _ in range(steps):
        off = F.col("y") - 1 / (1 + F.exp(-logit(F.col("x"), weights, bias)))
        step = rows.select(F.explode("x").alias("i"), (off / F.sqrt(F.size("x"))).alias("g")).groupBy("i").agg(F.sum("g").alias("g"))
        for i, g in step.collect():  # at most dims rows
            weights[i] += RATE * (g / n * math.sqrt(dims) - RIDGE * weights[i])
        # rounding makes reruns agree whatever the order of the sums
        weights = [round(v, 9) for v in weights]
    return weights, bias


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's block probability of every row."""
    rule, verdict = fitting(rules)
    parts = with_parts(pages).withColumn("rule", rule).withColumn("ruled", verdict)
    labelled = (
        parts.where("rule is not null").select("host", "path", (F.col("ruled") == "block").cast("int").alias("blocked")).distinct()
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample)
    )
    weights, bias = fit(labelled)
    p = 1 / (1 + F.exp(-logit(features(), weights, bias)))
    return (
        parts.withColumn("p_block", p)
        .withColumn("verdict", F.coalesce("ruled", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
