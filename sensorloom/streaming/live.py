"""Live variants of the batch operators on Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def tumbling(stream: DataFrame, key: str, ts: str, x: str, width: str, late: str) -> DataFrame:
    """Count, mean and extremes of each window; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))


def sliding(stream: DataFrame, key: str, ts: str, x: str, width: str, step: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, step), key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def ema(stream: DataFrame, key: str, order: str, x: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean of each key, kept as state between batches."""
    kind = stream.schema[key].dataType.simpleString()

    def update(group, batches, state):
        n, m = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[x].dropna():
            m = v if n == 0 else (1 - alpha) * m + alpha * v
            n += 1
        state.update((n, float(m)))
        yield pd.DataFrame({key: [group[0]], "n": [n], "ema": [float(m)]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, ema double", "n long, m double", "update", "NoTimeout")


def marker_edges(stream: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """Changes of a marker against the last one seen, across batches."""
    kind = stream.schema[key].dataType.simpleString()

    def update(group, batches, state):
        was = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            now = getattr(row, marker)
            if now is not None and now != was:
                out.append((group[0], int(getattr(row, order)), was, now))
                was = now
        state.update((was,))
        yield pd.DataFrame(out, columns=[key, order, "previous", "marker"])

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {order} long, previous string, marker string", "was string", "append", "NoTimeout")
