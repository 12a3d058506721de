"""Provenance: canonical digests, decision logs, workflow summaries. Payloads are small driver values."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.windows import recommend_exclusions, signal_windows


def certificate(payload: dict) -> dict:
    """The payload with a SHA-256 digest of its canonical JSON."""
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)
    return {"payload": payload, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def is_valid(cert: dict) -> bool:
    return certificate(cert["payload"])["sha256"] == cert["sha256"]


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of a table's rows, as one aggregation."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


def decision_log(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "stage string, decision string, reason string")


def pipeline_steps(done: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and done steps: missing, extra, or present."""
    d = done.select("step", F.lit(True).alias("_d")).distinct().join(expected.select("step", F.lit(True).alias("_e")).distinct(), "step", "full_outer")
    return d.select("step", F.when(F.col("_d").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("present").alias("status"))


def workflow(df: DataFrame, unit: str, keys, x: str, order, least: float = 50.0, review: float = 80.0) -> dict[str, DataFrame]:
    """Windows, exclusion advice and a one-row overview of one recording table."""
    w = signal_windows(df, [unit, *keys], x, order)
    e = recommend_exclusions(w, unit, "usable_pct", "sd", least, review)
    over = e.agg(F.count("*").alias("units"), F.sum("n_windows").alias("windows"), F.sum("n_exclude").alias("excluded"))
    return {"windows": w, "exclusions": e, "overview": over}
