"""Grouped waveform functions against plain formulas."""

import math

import numpy as np
from pyspark.sql import functions as F

from sensorloom.operators import beats as B, complexity as Y, waveforms as V
from sensorloom.operators.joins import lag_correlations
from sensorloom.operators.quality import mad_artifacts
from sensorloom.operators.scans import second_order


def test_taller_peaks_suppress_near_ones(spark):
    rows = [(k, float(v)) for k, v in enumerate([0, 5, 0, 6, 0, 0, 0, 4, 0])]
    d = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in rows[:2]], "g string, k long, x double")
    p = B._neighbours(B.signal(d, ["g"], "x", "k", ["k"]), ["g"]).where(B.IS_PEAK).where("v >= 1")
    assert [sorted(r.rn for r in B.thinned(p, ["g"], n).collect()) for n in (3, 1)] == [[3, 7], [1, 3, 7]]  # the two samples of b have no peak


def test_scr_peaks_have_onset_and_recovery(spark):
    x = [0.0, 0.0, 1.0, 4.0, 3.0, 1.0, 0.0]
    df = spark.createDataFrame([("a", float(k), v) for k, v in enumerate(x)] + [("b", 0.0, None)], "g string, t double, x double")
    r = B.scr_peaks(df, ["g"], "x", "t", ["t"], 1.0, 2, 0.5).collect()
    assert [(p.g, p.onset, p.peak, p.amplitude, p.recovery) for p in r] == [("a", 1.0, 3.0, 4.0, 2.0)]


def test_spectrum_equals_averaged_periodograms(spark):
    rng = np.random.default_rng(5)
    series = {"tone": np.sin(2 * np.pi * 4 * np.arange(512) / 32), "noise": rng.normal(size=203), "short": rng.normal(size=21), "odd": rng.normal(size=65)}
    rows = [(g, k, float(v)) for g, x in series.items() for k, v in enumerate(x)] + [("noise", 999, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double").repartition(3)
    got = {}
    for r in V.power_spectrum(df, "g", "x", ["k"], 32.0).collect():
        got.setdefault(r.g, {})[r.f] = r.power
    assert set(got) == set(series) and max(got["tone"], key=got["tone"].get) == 4.0
    for g, x in series.items():
        size = min(64, len(x))
        w = np.hanning(size)
        p = np.mean([np.abs(np.fft.rfft((x[a : a + size] - x[a : a + size].mean()) * w)) ** 2 for a in range(0, len(x) - size + 1, size // 2)], 0) / (32 * (w**2).sum())
        f = np.fft.rfftfreq(size, 1 / 32)
        assert np.allclose(sorted(got[g]), f) and np.allclose([got[g][k] for k in sorted(got[g])], p)


def test_low_pass_equals_the_recursion_across_blocks(spark):
    rng = np.random.default_rng(6)
    x = [None, None, *[None if k % 97 == 5 else float(v) for k, v in enumerate(rng.normal(size=70).cumsum() + 900)]]
    rows = [("a", k, v) for k, v in enumerate(x)] + [(None, k, v) for k, v in enumerate(x[5:])] + [("gone", 2**60 + 1, None), ("gone", 2**60 + 3, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double").repartition(3)
    w = math.tan(math.pi * 0.5 / 4)
    k0 = 1 / (1 + math.sqrt(2) * w + w * w)
    b, a1, a2 = w * w * k0, 2 * (w * w - 1) * k0, (1 - math.sqrt(2) * w + w * w) * k0
    d = df.where("x is not null")
    for size in (1024, 16, 7):
        got = {(r.g, r.k): r.y for r in second_order(d, ["g"], ["k"], "x", (a1, a2), (b, 2 * b, b), "y", size).collect()}
        for g, s in (("a", x), (None, x[5:])):
            v = [(k, q) for k, q in enumerate(s) if q is not None]
            x1 = x2 = y1 = y2 = v[0][1]
            for k, q in v:
                x1, x2, y1, y2 = q, x1, b * (q + 2 * x1 + x2) - a1 * y1 - a2 * y2, y1
                assert np.isclose(got[g, k], y1), (size, g, k)
    out = {(r.g, r.id): r.filtered for r in V.low_pass(df, "g", "x", ["k"], 0.5, 4.0).collect()}
    assert len(out) == len(rows) and out["gone", 2**60 + 1] is None and out["gone", 2**60 + 3] is None and np.isclose(out["a", 0], x[2])


def test_granger_direction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame([("a", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g string, k long, x double, y double")
    r = V.granger(df, "g", "x", "y", ["k"], 1).first()
    assert r.x_to_y > 50 > r.y_to_x


def test_short_groups_do_not_crash(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, None)], "g string, k long, x double")
    assert B.template_similarity(df, ["g"], "x", ["k"], 2, 1).count() == 2
    for out in (Y.recurrence(df, ["g"], "x", ["k"]), V.ar_spectrum_order(df, "g", "x", ["k"], 3), Y.multiscale_entropy(df, ["g"], "x", ["k"]), Y.sample_entropy(df, ["g"], "x", ["k"]), V.granger(df.withColumn("y", F.col("x")), "g", "x", "y", ["k"], 1)):
        assert [r.g for r in out.select("g").distinct().collect()] == ["a"]  # a recording without samples has no row
    assert Y.detrended_fluctuation(df, ["g"], "x", ["k"]).count() == 0
    assert V.power_spectrum(df, "g", "x", ["k"], 4.0).count() == 0


def test_complexity_equals_plain_formulas(spark):
    rng = np.random.default_rng(9)
    series = {"a": rng.normal(size=70), "b": np.round(np.sin(np.arange(90) / 3), 1), "c": np.ones(12)}
    rows = [(g, k, float(v)) for g, x in series.items() for k, v in enumerate(x)] + [("a", -1, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double").repartition(3)
    rec = {r.g: r for r in Y.recurrence(df, ["g"], "x", ["k"]).collect()}
    ent = {r.g: r.entropy for r in Y.sample_entropy(df, ["g"], "x", ["k"]).collect()}
    dfa = {r.g: r.dfa for r in Y.detrended_fluctuation(df, ["g"], "x", ["k"]).collect()}
    for g in "ab":
        x = series[g]
        n, tol = len(x), 0.2 * x.std(ddof=1)
        near = np.abs(x[:, None] - x[None, :]) <= tol
        lines = [len(run) for k in range(1, n) for run in "".join("1" if v else "0" for v in np.diagonal(near, k)).split("0") if run]
        assert abs(rec[g].rate - 2 * sum(lines) / (n * (n - 1))) < 1e-12 and abs(rec[g].determinism - sum(v for v in lines if v >= 2) / sum(lines)) < 1e-12
        count = [sum(np.abs(x[i : i + m] - x[j : j + m]).max() <= tol for i in range(n - 2) for j in range(i)) for m in (2, 3)]
        assert abs(ent[g] + math.log(count[1] / count[0])) < 1e-12
        y, pts = np.cumsum(x - x.mean()), []
        for size in (4, 6, 8, 12, 16, 24, 32):
            if n >= 2 * size:
                boxes = [y[a : a + size] for a in range(0, n - n % size, size)]
                rest = [((b - np.polyval(np.polyfit(np.arange(size), b, 1), np.arange(size))) ** 2).mean() for b in boxes]
                pts.append((math.log(size), math.log(np.mean(rest)) / 2))
        assert abs(dfa[g] - np.polyfit(*zip(*pts), 1)[0]) < 1e-8
    assert rec["c"].rate is None and ent["c"] is None and dfa.get("c") is None


def test_lagged_regressions_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=60).cumsum(), rng.normal(size=60)
    df = spark.createDataFrame([("a", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g string, k long, x double, y double")
    rss = lambda m, v: float(((v - m @ np.linalg.lstsq(m, v, rcond=None)[0]) ** 2).sum())

    def f(a, b, lags):
        own = np.stack([np.ones(60 - lags), *[b[lags - k - 1 : 59 - k] for k in range(lags)]], 1)
        full = np.concatenate([own, np.stack([a[lags - k - 1 : 59 - k] for k in range(lags)], 1)], 1)
        small, large = rss(own, b[lags:]), rss(full, b[lags:])
        return (small - large) / lags / (large / (60 - lags - full.shape[1]))

    r = V.granger(df, "g", "x", "y", ["k"], 2).first()
    assert r.n == 60 and abs(r.x_to_y - f(x, y, 2)) < 1e-6 and abs(r.y_to_x - f(y, x, 2)) < 1e-6
    v, best = x - x.mean(), (np.inf, 0, float(x.var()))
    for p in range(1, 5):
        s = rss(np.stack([v[p - k - 1 : 59 - k] for k in range(p)], 1), v[p:]) / (60 - p)
        best = min(best, ((60 - p) * math.log(s) + 2 * p, p, s))
    r = V.ar_spectrum_order(df, "g", "x", ["k"], 4).first()
    assert r.ar_order == best[1] and abs(r.residual_var - best[2]) < 1e-8


def test_lags_of_all_pairs_come_from_one_window(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in rng.normal(size=60)]
    rows = [("a", k, x[k], x[k - 3] if k >= 3 else None, 1.0) for k in range(60)] + [(None, k, x[k], x[k + 2], 1.0) for k in range(50)] + [("few", k, 1.0, 2.0, 3.0) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double, flat double").repartition(3)
    got = {(r.g, r.signal_1, r.signal_2): (r.best_lag, r.best_r) for r in lag_correlations(df, ["g"], [("x", "y"), ("x", "flat"), ("y", "x")], ["k"], 4).collect()}
    # the first meets the second lag rows later; a constant has no correlation, four rows have no row at all
    assert set(got) == {(g, a, b) for g in ("a", None) for a, b in (("x", "y"), ("x", "flat"), ("y", "x"))}
    assert {k: v[0] for k, v in got.items() if k[2] != "flat"} == {("a", "x", "y"): 3, (None, "x", "y"): -2, ("a", "y", "x"): -3, (None, "y", "x"): 2}
    assert np.isclose(got["a", "x", "y"][1], 1) and got["a", "x", "flat"] == (None, None)


def test_artifact_types_of_steps(spark):
    a = [*np.linspace(1, 1.2, 10), *[1.2] * 8, 5, 1.3, 1.31, 8, 8.1, 8.2]
    rows = [("a", k, float(v)) for k, v in enumerate(a)] + [("w", k, v) for k, v in enumerate([0.0, 0.0, 10.0, 10.0, None, 10.0])] + [("one", 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k long, x double").repartition(3)
    got = {(r.g, r.k): r.mad_artifact_type for r in mad_artifacts(df, ["g"], "x", ["k"], 4.0, 1e-8, 4, 5.0).collect()}
    step = np.diff(a)
    spread = 1.4826 * np.median(np.abs(step - np.median(step)))
    for k, d in enumerate(step, 1):
        needle, flat, wall = abs(d - np.median(step)) > 4 * spread, 10 <= k <= 17, abs(d) > 5
        assert got["a", k] == ("multiple" if needle or (flat and wall) else "flatline" if flat else "wall" if wall else "none"), k
    assert [got["w", k] for k in range(6)] == ["none", "none", "wall", "none", "none", "none"] and got["one", 0] == "none" == got["a", 0]
