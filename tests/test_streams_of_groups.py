"""Many short groups go through Python in streams of batches; groups go on from batch to batch."""

import pytest

from pyspark.sql import functions as F

from sensorloom.operators import scans, tiles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(params=[1, 3, 10000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_recurrences_take_no_call_a_group(spark, batches):
    rows = [(u, 2**60 + k, float(k), None if k % 5 == 0 else float((k * 7 + (u or 0)) % 11)) for u in (None, 1, 2**60 + 1) for k in range(23)] + [(7, 1, 0.0, None), (8, 1, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "u long, id long, t double, x double")
    for width in (4.0, 100.0):
        out = scans.adaptive_ema(df, ["u"], "x", ["t"], width, 0.2, 100.0)
        assert "InPandas" not in plan(out)
        got = {(r.u, r.id): r.ema for r in out.collect()}
        assert len(got) == len(rows)
        m, was = None, ()
        for u, k, _, x in rows:
            m = None if was != u else m
            m, was = m if x is None else x if m is None else 0.8 * m + 0.2 * x, u
            assert (got[u, k] is None) == (m is None) and (m is None or abs(got[u, k] - m) < 1e-9)


def test_plots_take_no_call_a_tile(spark, batches):
    rows = [(u, k, float((k * k + (u or 0)) % 17)) for u in (None, 1, 2**60 + 1) for k in range(40)]
    df = spark.createDataFrame(rows, "u long, t long, x double")
    points = tiles.places(df, ["u"], "x", ["t"]).withColumn("tol", F.lit(2.0))
    out = tiles.run_counts(points, ["u"], kinds="dv", tile=8)
    assert "InPandas" not in plan(out)
    got = {}
    for r in out.collect():
        got[r.u, r.kind] = got.get((r.u, r.kind), 0) + r.len * r.k
    for u in (None, 1, 2**60 + 1):
        x = [v for w, _, v in rows if w == u]
        pairs = sum(abs(a - b) <= 2 for k, a in enumerate(x) for b in x[:k])
        assert got[u, "d"] == pairs and got[u, "v"] == 2 * pairs + len(x)


def test_second_order_takes_no_call_a_block(spark, batches):
    rows = [(u, 2**60 + k, float(k), float((k * 7 + (u or 0)) % 11)) for u in (None, 1, 2**60 + 1) for k in range(22)]
    df = spark.createDataFrame(rows, "u long, id long, t double, x double")
    out = scans.second_order(df, ["u"], ["t", "id"], "x", (-0.9, 0.4), (0.2, 0.1, 0.2), "y", size=4)
    assert "InPandas" not in plan(out)
    got = {(r.u, r.id): r.y for r in out.collect()}
    for g in (None, 1, 2**60 + 1):
        x = [v for u, _, _, v in rows if u == g]
        x1 = x2 = y1 = y2 = x[0]
        for k, v in enumerate(x):
            # the state before the first row is at rest on it
            y = x[0] + 0.2 * (v - x[0]) + 0.1 * (x1 - x[0]) + 0.2 * (x2 - x[0]) + 0.9 * (y1 - x[0]) - 0.4 * (y2 - x[0])
            x1, x2, y1, y2 = v, x1, y, y1
            assert abs(got[g, 2**60 + k] - y) < 1e-9
