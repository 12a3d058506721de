"""Pupil repair and interval segments: runs, ends, spikes, missing values, reasons."""

import pytest

from sensorloom.operators import repair as A


def pupils(spark, rows):
    return spark.createDataFrame(rows, "g string, k long, x double").repartition(3)


def test_gaps_are_filled_by_each_method(spark):
    df = pupils(spark, [("a", k, v) for k, v in enumerate([None, 2.0, 0.0, -1.0, 8.0, None])] + [("b", 0, None)])
    want = {"linear": [2, 2, 4, 6, 8, 8], "locf": [2, 2, 2, 2, 8, 8], "nocb": [2, 2, 8, 8, 8, 8], "constant": [5, 2, 5, 5, 8, 5]}
    for method, w in want.items():
        got = {(r.g, r.k): r for r in A.clean_pupil(df, ["g"], "x", ["k"], method).collect()}
        assert [got["a", k].clean for k in range(6)] == pytest.approx(w), method
        assert [got["a", k].was_imputed for k in range(6)] == [True, False, True, True, False, True]
        assert got["b", 0].clean is None and got["b", 0].was_invalid and not got["b", 0].was_imputed
    short = {(r.g, r.k): r.clean for r in A.clean_pupil(df, ["g"], "x", ["k"], "linear", max_gap=1).collect()}
    assert [short["a", k] for k in range(6)] == [2, 2, None, None, 8, 8]
    with pytest.raises(ValueError):
        A.clean_pupil(df, ["g"], "x", ["k"], "spline")


def test_spikes_by_the_whole_table_or_by_key(spark):
    rows = [(None, k, v) for k, v in enumerate([3.0, 3.1, 2.9, 30.0, 3.0])] + [("b", k, 30.0 + k / 10) for k in range(5)] + [("flat", k, 3.0) for k in range(4)]
    by_key = {(r.g, r.k): r for r in A.clean_pupil(pupils(spark, rows), ["g"], "x", ["k"], spread_keys=["g"]).collect()}
    assert [k for k, r in by_key.items() if r.was_spike] == [(None, 3)] and by_key[None, 3].clean == pytest.approx(2.95)
    every = A.clean_pupil(pupils(spark, rows).where("g = 'flat' or g is null"), ["g"], "x", ["k"])
    # over the whole table most values are 3.0: the MAD is 0 and so is the IQR, so nothing is a spike
    assert every.where("was_spike").count() == 0
    s = {r.g: r for r in A.cleaning_summary(every, ["g"]).collect()}
    assert s["flat"].n_missing_after == 0 and s["flat"].n_spike_samples == 0 and s[None].n_imputed_samples == s[None].n_spike_samples
    assert A.clean_pupil(pupils(spark, rows[:0]), ["g"], "x", ["k"]).count() == 0


def test_segments_give_their_reasons(spark):
    good = [("a", 10.0 + k, 800.0 + k) for k in range(30)] + [("a", 70.0 + k, 800.0) for k in range(3)]
    bad = [("b", 0.0, None), ("b", 1.0, 500.0), ("b", 2.0, 900.0), ("b", 3.0, 2500.0), (None, 5.0, 700.0), ("none", None, 800.0)]
    df = spark.createDataFrame(good + bad, "g string, t double, rr double").repartition(3)
    r = {(x.g, x.segment_id): x for x in A.interval_segments(df, ["g"], "rr", "t", ["t"]).collect()}
    assert set(r) == {("a", 1), ("a", 2), ("b", 1), (None, 1)}
    assert r["a", 1].quality_ok and r["a", 1].reasons == "ok" and r["a", 1].duration_s == 29.0 and r["a", 1].n_clean_beats == 30
    assert r["a", 2].reasons == "too_few_clean_beats;duration_too_short"
    b = r["b", 1]
    assert (b.n_implausible_rr, b.n_large_successive_changes, b.n_clean_beats, b.artifact_prop, b.median_rr_ms, b.max_rr_ms) == (2, 2, 1, 0.75, 500.0, 2500.0)
    assert b.reasons == "too_few_clean_beats;duration_too_short;high_artifact_prop;implausible_rr;large_successive_change"
    assert r[None, 1].duration_s == 0.7 and r[None, 1].segment_start_s == 5.0
