"""Detrending, artifact intervals, stream merges, folder profiles and layout checks against plain formulas."""

import math

import numpy as np
import pandas as pd
import pytest

from sensorloom.functions import blocks as B
from sensorloom.operators import cleaning as C, scans as R, streams as S
from sensorloom.sources import exports as X, profiles as P


def runs(v):
    i = 0
    while i < len(v):
        j = i + 1
        while j < len(v) and v[j] == v[i]:
            j += 1
        yield v[i], i, j
        i = j


@pytest.mark.parametrize("method", ["median", "mean", "linear"])
@pytest.mark.parametrize("seconds", [20.0, 0.001])
def test_local_trend_equals_the_plain_window(spark, method, seconds):
    r = np.round(np.random.default_rng(3).normal(800, 60, 120))
    t = np.cumsum(r) / 1000
    rows = [("a", k, float(v)) for k, v in enumerate(r)] + [("b", 0, 800.0), ("b", 1, -1.0), ("b", 2, 810.0), ("b", 3, None)]
    got = C.detrend_intervals(spark.createDataFrame(rows, "g string, k long, x double"), ["g"], "x", ["k"], seconds=seconds, method=method).orderBy("g", "k").collect()
    want = []
    for at in t:
        near = np.flatnonzero(abs(t - at) <= seconds / 2)
        want.append(np.median(r[near]) if method == "median" else np.mean(r[near]) if method == "mean" or len(near) < 3 else np.polyval(np.polyfit(t[near], r[near], 1), at))
    assert np.allclose([q.trend_ms for q in got[:120]], want) and np.allclose([q.rri_detrended_ms for q in got[:120]], r - want + np.mean(want))
    assert [(q.k, q.trend_ms) for q in got[120:]] == [(0, None), (2, None)]


def widened(flags, n):
    out = flags.copy()
    for k in np.flatnonzero(flags):
        out[max(0, k - n) : k + n + 1] = True
    return out


def plain_cleaning(x, t, rate):
    bad = ~np.isfinite(x) | (x < 0) | (x > 50)
    slope = np.r_[np.nan, abs(np.diff(x)) / np.diff(t)]
    steep = np.isfinite(slope) & (slope > 10)
    clip, island = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for v, i, j in runs(np.r_[False, abs(np.diff(x)) <= 1e-5]):
        if v and j - i >= max(2, round(0.5 * rate)):
            clip[i:j] = True
    for v, i, j in runs(~(bad | steep | clip)):
        if v and j - i < rate:
            island[i:j] = True
    artifact = widened(bad | steep | clip | island, round(0.25 * rate))
    clean = pd.Series(np.where(artifact, np.nan, x)).interpolate(limit_direction="both").to_numpy()
    n = max(1, round(0.25 * rate))
    smooth = pd.Series(clean).rolling(n, center=True, min_periods=n).mean().to_numpy()
    named = [("range_or_nonfinite", bad), ("slope", steep), ("clipping", clip), ("short_valid_island", island)]
    reason = [";".join(w for w, f in named if f[k]) or ("artifact_epoch" if artifact[k] else "accepted") for k in range(len(x))]
    return artifact, reason, clean, np.where(np.isfinite(smooth), smooth, clean)


@pytest.mark.parametrize("rate, width", [(20, 16), (20, 4096), (16, 64)])
def test_cleaning_equals_the_plain_rules(spark, rate, width):
    t = np.arange(400) / rate
    x = 5 + np.sin(t) + np.random.default_rng(4).normal(0, 0.01, 400)
    x[50:53], x[60], x[150:175], x[230], x[245], x[395], x[3] = 80, np.nan, 4.2, -1, -1, np.nan, 99
    x[200] += 3
    df = spark.createDataFrame([("a", float(a), None if math.isnan(v) else float(v)) for a, v in zip(t, x)] + [("none", float(k), None) for k in range(5)], "g string, t double, x double")
    cleaned = C.clean_conductance(df, ["g"], "x", "t", ["t"], float(rate), width=width)
    got = cleaned.orderBy("g", "t").collect()
    artifact, reason, clean, smooth = plain_cleaning(x, t, rate)
    assert [q.artifact for q in got[:400]] == artifact.tolist() and [q.artifact_reason for q in got[:400]] == reason
    assert np.allclose([q.scr_clean for q in got[:400]], clean) and np.allclose([q.scr_processed for q in got[:400]], smooth)
    assert all(q.artifact and q.scr_clean is None for q in got[400:])
    epochs = C.artifact_epochs(cleaned, ["g"], "t", ["t"]).where("g = 'a'").orderBy("lo").collect()
    assert [(q.lo, q.hi, q.start_s) for q in epochs] == [(i, j - 1, t[i]) for v, i, j in runs(artifact) if v]


def test_intervals_merge_and_cover(spark):
    i = spark.createDataFrame([("g", 0, 3), ("g", 2, 5), ("g", 6, 6), ("g", 9, 10), (None, 1, 1)], "k string, lo long, hi long")
    got = lambda gap: sorted((r.k or "", r.lo, r.hi) for r in B.merged(i, ["k"], gap).collect())
    assert got(0) == [("", 1, 1), ("g", 0, 6), ("g", 9, 10)] and got(2) == [("", 1, 1), ("g", 0, 10)]
    rows = spark.createDataFrame([("g", n) for n in range(12)] + [(None, 0), (None, 1)], "k string, n long")
    held = B.covering(rows, ["k"], "n", {"c": B.merged(i, ["k"])}, 4).where("c is not null").collect()
    assert {(r.k, r.n) for r in held} == {("g", n) for n in (*range(7), 9, 10)} | {(None, 1)}


@pytest.mark.parametrize("tolerance", [None, 0.3])
def test_streams_meet_the_nearest_row(spark, tolerance):
    rng = np.random.default_rng(5)
    times = {"ref": np.arange(0, 10, 0.5), "b": np.sort(rng.uniform(0, 10, 33)), "c": np.array([2.0, 8.0])}
    times["b"][5] = times["b"][4]
    table = {n: spark.createDataFrame([("u", k, float(a), (1 << 60) + k) for k, a in enumerate(t)], "g string, k long, t double, v long") for n, t in times.items()}
    streams = {"ref": S.Stream(table["ref"], "t", ["v"], ["k"]), "b": S.Stream(table["b"], "t", ["v"], ["k"], offset=0.2, lag=0.05), "c": S.Stream(table["c"], "t", ["v"], ["k"])}
    rows = S.merge_nearest(streams, ["g"], "ref", tolerance).collect()
    assert len(rows) == 20
    for r in rows:
        for n, t in (("b", times["b"] + 0.2 - 0.05), ("c", times["c"])):
            k = int(np.argmin(abs(t - r.relative_s)))
            near = tolerance is None or abs(t[k] - r.relative_s) <= tolerance
            assert r[f"{n}__v"] == ((1 << 60) + k if near else None)
    streams["b"].rate = streams["c"].rate = streams["ref"].rate = 4.0
    even = S.synchronised(streams, ["g"], "ref", "none", dejitter=True)["b"].orderBy("k").collect()
    assert np.allclose([r.relative_s for r in even], times["b"][0] + 0.15 + np.arange(33) / 4)
    with pytest.raises(ValueError):
        S.corrected(S.Stream(table["ref"], "t", ["v"], ["k"]), ["g"], dejitter=True)


def test_recurrences_keep_large_ids_and_null_groups(spark):
    big = 1 << 60
    rows = [("a", float(k), big + 2 * k + 1 if k % 3 else None, float(k % 5) if k % 4 else None) for k in range(50)] + [(None, 1.0, big + 1, 2.0)]
    got = {(r.g, r.t): r for r in R.adaptive_ema(spark.createDataFrame(rows, "g string, t double, id long, x double"), ["g"], "x", ["t"], 7.0).collect()}
    value = None
    for g, t, i, x in rows[:50]:
        value = value if x is None else x if value is None else 0.9 * value + 0.1 * x
        r = got[g, t]
        assert r.id == i and (r.ema == value or math.isclose(r.ema, value))
    assert (got[None, 1.0].id, got[None, 1.0].ema) == (big + 1, 2.0)


def test_folder_profiles(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "S01_bio.csv").write_text('﻿TIME,GSR_US,HR,label\n0,1.5,NA,"a,b"\n1,NaN,70,c\n2,1.5,70,\n')
    (a / "S02_bio.csv").write_text("CNT;IBI;TTL0\n0;800;0\n1;810;0\n")
    (a / "S03_head.csv").write_text("TIME,FPOGX\n")
    (b / "x.csv").write_text("TIME\tnote\n1\tz\n")
    p = P.profile_folder(spark, str(a))
    columns = {(r.file.rsplit("/")[-1], r.column): r for r in p["columns"].collect()}
    r = columns["S01_bio.csv", "GSR_US"]
    assert (r.role, r.type, r.n_rows, r.n_missing, r.n_unique, r.numeric_sd, r.constant) == ("eda_gsr", "numeric", 3, 1, 1, 0.0, True)
    r = columns["S01_bio.csv", "label"]
    assert (r.role, r.type, r.n_missing, r.n_unique) == ("other", "character", 1, 2)
    assert columns["S02_bio.csv", "TTL0"].all_zero and columns["S03_head.csv", "TIME"].constant is None
    files = {r.file_label: r for r in p["files"].collect()}
    r = files["S02_bio.csv"]
    assert (r.n_rows, r.n_cols, r.column_signature, r.time_columns, r.gaze_columns, r.zero_numeric_cols, r.extension) == (2, 3, "CNT | IBI | TTL0", "CNT", None, 1, ".csv")
    o = p["overview"].first()
    assert (o.n_files, o.n_read_errors, o.total_rows_profiled, o.n_unique_column_sets, o.any_ttl_columns, o.any_aoi_columns) == (3, 0, 5, 3, True, False)
    other = P.profile_folder(spark, str(b))
    assert {r.issue for r in other["warnings"].collect()} == {"no_signal_columns_detected"}
    both = P.compare_profiles({"a": p, "b": other})
    present = {r.column: r.profiles_present for r in both["column_presence"].collect()}
    assert present["TIME"] == "a; b" and present["note"] == "b" and both["overview"].count() == 2
    with pytest.raises(ValueError):
        P.compare_profiles({"a": p})


def test_layout_checks(spark, tmp_path):
    (tmp_path / "sub-01").mkdir()
    (tmp_path / "sub-01" / "S01_all_gaze.csv").write_text("x\n1\n")
    (tmp_path / "participants.tsv").write_text("id\n1\n")
    checks = P.check_layout(spark, str(tmp_path))
    got = {r.check: (r.status, r.detail) for r in checks.collect()}
    assert got["root_directory"][0] == "pass" and got["participants.tsv"] == ("pass", "Present.") and got["dataset_description.json"][0] == "warn"
    assert got["subject_directories"] == ("pass", "1 subject directories detected.") and got["export_files"] == ("pass", "1 export files detected.")
    assert tuple(P.layout_summary(checks).first()) == (5, 4, 1, 0, True, True)
    assert tuple(P.layout_summary(P.check_layout(spark, str(tmp_path / "none"))).first()) == (1, 0, 0, 1, False, True)


def test_event_log_ids_and_units(spark, tmp_path):
    (tmp_path / "log.csv").write_text("id,trial_id,time,label\n7,T1,1000,a\n8,T2,3000,b\n9,T3,6000,c\n")
    got = [(r.event_id, r.event_time) for r in X.read_event_log(spark, str(tmp_path / "log.csv")).orderBy("event_time").collect()]
    assert got == [("T1", 1.0), ("T2", 3.0), ("T3", 6.0)]


def test_many_polygons_meet_points_by_bands(spark):
    from sensorloom.operators import joins as J

    rng = np.random.default_rng(8)
    shapes = [(f"p{k}", [(float(a + r * math.cos(v)), float(b + r * math.sin(v))) for v in np.linspace(0, 6, 7)]) for k, (a, b, r) in enumerate(rng.uniform(1, 9, (30, 3)))]
    polygons = spark.createDataFrame(shapes, "aoi string, vertices array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(0, 10, (300, 2)))], "id long, x double, y double")
    few, many = (sorted(tuple(r) for r in J.in_polygon(points, polygons, "id", "x", "y", most).collect()) for most in (10_000, 10))
    assert few == many and len(few) > 100
