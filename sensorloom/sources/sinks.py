"""Sinks: delimited tables, physiological TSV with a JSON sidecar, interoperability tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.core import ordered


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").csv(path, header=True)


def write_physio(df: DataFrame, path: str, columns, order, rate_hz: float, start_s: float = 0.0) -> None:
    """Compressed headerless TSV per participant folder and a JSON sidecar, both through Spark's writers."""
    df.repartition("participant").sortWithinPartitions("participant", *order).select("participant", *columns).write.partitionBy("participant").csv(f"{path}/data", sep="\t", compression="gzip", nullValue="n/a")
    side = {"SamplingFrequency": rate_hz, "StartTime": start_s, "Columns": list(columns)}
    df.sparkSession.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.text(f"{path}/sidecar")


def eda_bridge(df: DataFrame, keys, x: str, t: str, unit: str = "us") -> DataFrame:
    """Zero-based time and conductance for decomposition tools."""
    us = {"ohm": F.when(F.col(x) > 0, 1e6 / F.col(x)), "us": F.col(x)}[unit]
    return df.select(*keys, (F.col(t) - F.min(t).over(Window.partitionBy(*keys))).alias("time_s"), us.alias("conductance_us"))


def beat_table(df: DataFrame, keys, ibi_ms: str, order, low: float = 300.0, high: float = 2000.0) -> DataFrame:
    """Plausible intervals, repeats collapsed, with cumulative beat time in seconds."""
    w = ordered(keys, order)
    d = df.where(F.col(ibi_ms).between(low, high)).withColumn("_was", F.lag(ibi_ms).over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col(ibi_ms)))
    return d.select(*keys, *order, F.col(ibi_ms).alias("ibi_ms"), (F.sum(ibi_ms).over(ordered(keys, order, Window.unboundedPreceding, 0)) / 1000).alias("time_s"))


def event_matrix(df: DataFrame, t: str, label: str, rate_hz: float) -> DataFrame:
    """Sample number, previous code and code of each event; codes rank the labels."""
    codes = df.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)))  # a design's labels
    return df.join(codes, label).select(F.round(F.col(t) * rate_hz).cast("long").alias("sample"), F.lit(0).alias("previous"), "code")


def looks_table(df: DataFrame, subject: str, trial: str, t: str, aoi: str, levels) -> DataFrame:
    """One boolean column an area and the track-loss flag."""
    return df.select(subject, trial, (F.col(t) * 1000).alias("time_ms"), F.col(aoi).isNull().alias("track_loss"), *[F.coalesce(F.col(aoi) == a, F.lit(False)).alias(a) for a in levels])
