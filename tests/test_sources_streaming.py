"""Reading exports, schema audits, sinks and live variants."""

import json

import pytest
from pyspark.sql import functions as F

from sensorloom.plans import provenance as P
from sensorloom.sources import exports as X, sinks as K
from sensorloom.streaming import live as L


def test_read_export_and_folder(spark, tmp_path):
    (tmp_path / "S01_bio.csv").write_text("TIME,GSR (µS),HR,\n0,1.5,NA,\n1,NaN,70,\n")
    (tmp_path / "S02_bio.csv").write_text("TIME;GSR (µS);IBI\n0;2.5;800\n")
    one = X.read_export(spark, str(tmp_path / "S01_bio.csv"))
    assert one.columns == ["TIME", "GSR (µS)", "HR"] and one.where("HR is null").count() == 1
    both = X.read_folder(spark, str(tmp_path))
    assert both.count() == 3 and {r[0] for r in both.select("source_participant").distinct().collect()} == {"S01", "S02"}
    assert X.standard_names(one).columns == ["TIME", "GSR_uS", "HR"]
    assert X.standard_names(one, True).columns == ["time", "gsr", "hr"]
    assert X.numeric(X.standard_names(one, True), ["gsr"]).agg(F.count("gsr")).first()[0] == 1


def test_roles_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "TTL0 double, TTLV double")
    assert [X.role_of(c) for c in df.columns] == ["marker", "marker_validity"]
    assert X.missing_columns(df, ["marker", "gsr"]) == ["gsr"]
    assert X.unique_names(["a", "a", "b"]) == ["a", "a_2", "b"]


def test_physio_sink(spark, tmp_path):
    df = spark.createDataFrame([("p1", 0.0, 1.0), ("p2", 0.0, None)], "participant string, t double, x double")
    K.write_physio(df, str(tmp_path / "out"), ["t", "x"], ["t"], 60.0)
    side = json.loads(spark.read.text(str(tmp_path / "out/sidecar")).first()[0])
    assert side["SamplingFrequency"] == 60.0 and spark.read.text(str(tmp_path / "out/data")).count() == 2


def test_certificate():
    c = P.certificate({"b": 1, "a": [1, 2]})
    assert P.is_valid(c) and c == P.certificate({"a": [1, 2], "b": 1})
    assert not P.is_valid({"payload": {"a": 2}, "sha256": c["sha256"]})


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_live_operators(spark):
    s = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(spark, L.tumbling(s, "event_type", "ts", "value", "7 days", "1 day"), "tumble", "complete")
    assert len(got) == batch.groupBy(F.window("ts", "7 days"), "event_type").count().count()
    got = _run(spark, L.sessions(s, "user_id", "ts", "30 minutes", "1 day"), "sess", "complete")
    assert sum(r.n for r in got) == batch.count()
    got = _run(spark, L.ema(s, "user_id", "event_id", "value", 0.1), "ema", "update")
    assert sum(r.n for r in got) == batch.where("value is not null").count()
    assert len(_run(spark, L.marker_edges(s, "user_id", "event_id", "event_type"), "edges", "append")) > 0


def test_event_logs_sessions_and_clocks(spark, tmp_path):
    (tmp_path / "p1_events.csv").write_text("Onset;Label;extra\n2.5;b;x\n1.0;;y\nbad;c;z\n")
    (tmp_path / "p1_all.csv").write_text("CNT,TIME,GSR\n1,0.0,5\n2,0.5,\n3,0.4,6\n")
    (tmp_path / "p2_all.csv").write_text("CNT\n1\n")
    log = X.read_event_log(spark, str(tmp_path / "p1_events.csv")).orderBy("event_time").collect()
    assert [(r.event_id, r.event_time, r.event_label, r.extra) for r in log] == [("1", 1.0, "event_1", "y"), ("2", 2.5, "b", "x")]
    files = X.read_session(spark, str(tmp_path), "p1")
    assert sorted(files) == ["p1_all.csv", "p1_events.csv"] and files["p1_all.csv"].count() == 3
    assert X.choose_clock(files["p1_all.csv"], order=["CNT"]) == "CNT"  # TIME steps back
    assert X.choose_clock(files["p1_events.csv"], order=["Onset"]) is None
    with pytest.raises(ValueError):
        X.read_session(spark, str(tmp_path), "p9")
