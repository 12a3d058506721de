"""Tiles, Kendall, pyramids, cluster bootstrap and convolution designs against plain formulas."""

import math

import numpy as np
import pandas as pd
import pytest

from sensorloom.functions import ranges
from sensorloom.operators import complexity as Y, designs as D, equity as E, pyramids as P, ranks as K, tiles as G


def series(spark, groups):
    rows = [(g, k, None if v is None or math.isnan(v) else float(v)) for g, x in groups.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, k long, x double")


def lengths(flags):
    out, n = [], 0
    for f in [*flags, False]:
        if f:
            n += 1
        elif n:
            out.append(n)
            n = 0
    return out


def plain_rqa(x, m, delay, line=2):
    n = len(x) - (m - 1) * delay
    e = np.column_stack([x[j * delay : j * delay + n] for j in range(m)])
    near = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2)) <= (0.2 * np.std(e.ravel(), ddof=1) or 2**-52)
    d = [v for k in range(-(n - 1), n) for v in lengths(np.diag(near, k))]
    v = [u for j in range(n) for u in lengths(near[:, j])]
    long_d, long_v = [u for u in d if u >= line], [u for u in v if u >= line]
    p = np.unique(long_d, return_counts=True)[1] / len(long_d)
    return near.mean(), sum(long_d) / near.sum(), sum(long_v) / near.sum(), np.mean(long_v) if long_v else None, -(p * np.log(p)).sum(), np.mean(long_d), max(d)


@pytest.mark.parametrize("tile, m, delay", [(7, 2, 1), (16, 3, 2), (1024, 2, 1)])
def test_recurrence_equals_the_whole_plot(spark, tile, m, delay):
    rng = np.random.default_rng(1)
    x = (800 + 40 * np.sin(np.arange(90) / 3) + rng.normal(0, 8, 90)).round()
    groups = {"a": x, None: x[:40], "flat": np.full(20, 800.0), "short": x[:5]}
    got = {r.g: r for r in G.recurrence_quantification(series(spark, groups), ["g"], "x", ["k"], m, delay, tile=tile).collect()}
    for g in ("a", None, "flat"):
        assert got[g].status == "hrv_rqa_extracted"
        for a, b in zip(got[g][2:9], plain_rqa(groups[g], m, delay)):
            assert a == b or math.isclose(a, b, abs_tol=1e-12)
    assert got["short"].status == "insufficient_intervals" and got["short"].recurrence_rate is None


def matches(x, m, tol):
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    return sum(int((np.abs(w[k + 1 :] - w[k]).max(1) <= tol).sum()) for k in range(len(w) - 1))


@pytest.mark.parametrize("tile", [5, 1024])
def test_entropies_equal_plain_matches(spark, tile, monkeypatch):
    monkeypatch.setattr(G, "TILE", tile)
    x = np.random.default_rng(2).normal(800, 30, 70).round()
    df = series(spark, {"a": x, "flat": np.full(30, 5.0), "short": x[:6]})
    for r in G.refined_multiscale_entropy(df, ["g"], "x", ["k"], (1, 3)).where("g = 'a'").collect():
        coarse = [x[o:][: (len(x) - o) // r.scale * r.scale].reshape(-1, r.scale).mean(1) for o in range(r.scale)]
        tol = 0.2 * np.std(x, ddof=1)
        assert (r.match_count_m, r.match_count_m1) == tuple(sum(matches(c, m, tol) for c in coarse) for m in (2, 3))
    tol = 0.2 * np.std(x, ddof=1)
    want = -math.log(matches(x, 3, tol) / matches(x[:-1], 2, tol))
    got = {r.g: r.entropy for r in Y.sample_entropy(df, ["g"], "x", ["k"]).collect()}
    assert math.isclose(got["a"], want) and got["flat"] is None


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if k % 3 else None, int(v), k) for k, v in enumerate(rng.integers(0, 50, 900))]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    from pyspark.sql import functions as F

    for r in ranges.running(df, ["g"], ["v", "id"], n=F.lit(1).cast("long"), s=F.col("v")).collect():
        ahead = [b for a, b, c in rows if a == r.g and (b, c) < (r.v, r.id)]
        assert (r.n_before, r.s_before, r.n_total) == (len(ahead), sum(ahead), sum(a == r.g for a, *_ in rows))


def plain_tau(x, y):
    k = np.triu_indices(len(x), 1)
    dx, dy = np.sign(np.subtract.outer(x, x))[k], np.sign(np.subtract.outer(y, y))[k]
    c, d = int((dx * dy > 0).sum()), int((dx * dy < 0).sum())
    scale = math.sqrt((dx != 0).sum()) * math.sqrt((dy != 0).sum())
    return c, d, (c - d) / scale if scale and len(x) >= 3 else None


def test_kendall_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    data = {
        "norm": (rng.normal(size=300), rng.normal(size=300)), "ties": (rng.integers(0, 5, 400), rng.integers(0, 7, 400)), "hot": (np.where(rng.random(500) < 0.4, 1.0, rng.normal(size=500)), rng.normal(size=500)),
        "up": (np.arange(50), np.arange(50)), "down": (np.arange(50), -np.arange(50)), "flat": (np.ones(9), np.arange(9)), "two": (np.array([1, 2]), np.array([2, 1])), None: (rng.normal(size=37).round(1), rng.normal(size=37).round(1)),
    }
    rows = [(g, float(a), float(b)) for g, (x, y) in data.items() for a, b in zip(x, y)] + [("norm", None, 1.0), ("none", None, None)]
    got = {r.g: r for r in K.kendall(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert set(got) == set(data)
    for g, (x, y) in data.items():
        c, d, t = plain_tau(x, y)
        assert (got[g].n, got[g].concordant, got[g].discordant) == (len(x), c, d)
        assert got[g].tau == t or math.isclose(got[g].tau, t, abs_tol=1e-12)


def test_rank_correlation_finds_the_lag(spark):
    y = np.random.default_rng(5).normal(size=80)
    rows = [("a", k, float(y[k - 2]) if k >= 2 else None, float(y[k])) for k in range(80)] + [("b", 0, 1.0, None)]
    got = {r.g: r for r in K.rank_correlation(spark.createDataFrame(rows, "g string, k long, x double, y double"), ["g"], "x", "y", ["k"], 3).collect()}
    assert (got["a"].n, got["a"].best_lag, got["a"].best_lag_correlation) == (78, 2, 1.0)
    assert (got["b"].n, got["b"].correlation, got["b"].best_lag) == (0, None, None)


def test_wavelet_power_equals_sliding_means(spark):
    groups = {"ms": 800 + 40 * np.sin(np.linspace(0, 8 * np.pi, 128)), "s": np.random.default_rng(3).normal(0.8, 0.1, 8), "short": np.ones(7)}
    psd = P.wavelet_power(series(spark, groups), ["g"], "x", ["k"])
    rows = psd.collect()
    assert {r.g for r in rows} == {"ms", "s"}
    for r in rows:
        x = groups[r.g] / (1000 if r.g == "ms" else 1)
        s = r.scale_beats
        c = np.array([x[k : k + s].mean() - x[k + s : k + 2 * s].mean() for k in range(len(x) - 2 * s + 1)])
        assert r.n_coefficients == len(c) and math.isclose(r.wavelet_power, (c**2).mean() / 2, rel_tol=1e-6) and math.isclose(r.pseudo_frequency_hz, 1 / (2 * s * np.median(x)))
    assert sorted(r.scale_beats for r in rows if r.g == "ms") == [1, 2, 4, 8, 16, 32]
    bands = {(r.g, r.band): r for r in P.band_power(psd, ["g"]).collect()}
    assert bands["ms", "hf"].n_scales == 2 and bands["s", "vlf"].band_power == 0


def test_denoising_equals_repeated_means(spark):
    x = np.sin(np.arange(128) * 0.6) + np.random.default_rng(6).normal(0, 0.1, 128)
    x[[0, 5, 6, 127]] = np.nan
    z = pd.Series(x).interpolate(limit_direction="both").to_numpy()
    step = np.diff(z)
    limit = np.median(abs(step - np.median(step))) / 0.6745 * math.sqrt(2 * math.log(len(z)))
    smooth = pd.Series(z)
    for _ in range(3):
        smooth = smooth.rolling(2, min_periods=1).mean()
    rest = z - smooth.to_numpy()
    want = smooth.to_numpy() + np.sign(rest) * np.maximum(abs(rest) - limit, 0)
    want[np.isnan(x)] = np.nan
    rows = P.denoise(series(spark, {"a": x, "short": [1.0] * 5}), ["g"], "x", ["k"]).orderBy("g", "k").collect()
    assert np.allclose([np.nan if r.denoised is None else r.denoised for r in rows[:128]], want, equal_nan=True)
    assert rows[-1].denoised is None and rows[-1].denoise_status == "insufficient_finite_samples"


def test_agreement_and_its_intervals(spark):
    rng = np.random.default_rng(2)
    n = 400
    who, ref = rng.integers(0, 12, n), rng.normal(70, 8, n)
    cand = np.where(rng.random(n) < 0.1, np.nan, ref + rng.normal(1, 2, n))
    angle = rng.normal(20, 30, 12)[who]
    rows = [("a" if k % 2 else "b", None if k % 50 == 0 else int(who[k]), float(ref[k]), float(cand[k]), float(angle[k])) for k in range(n)] + [("one", 1, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "dev string, who long, ref double, cand double, angle double")
    ok = (np.arange(n) % 2 == 0) & ~np.isnan(cand)
    d = (cand - ref)[ok]
    want = {"retention_rate": ok.sum() / 200, "bias": d.mean(), "mae": abs(d).mean(), "rmse": math.sqrt((d**2).mean()), "loa_lower": d.mean() - 1.96 * d.std(ddof=1), "loa_upper": d.mean() + 1.96 * d.std(ddof=1),
            "lin_ccc": 2 * np.cov(ref[ok], cand[ok])[0, 1] / (ref[ok].var(ddof=1) + cand[ok].var(ddof=1) + (ref[ok].mean() - cand[ok].mean()) ** 2)}
    got = {(r.dev, r.metric): r for r in E.agreement_intervals(df, ["dev"], "who", "ref", "cand", 200).collect()}
    for name, v in want.items():
        r = got["b", name]
        assert math.isclose(r.estimate, v, rel_tol=1e-9) and r.ci_low <= v <= r.ci_high
    assert got["one", "bias"].estimate == 1.0 and got["one", "bias"].ci_low is None and got["one", "lin_ccc"].estimate is None
    k = ~np.isnan(cand) & (np.arange(n) % 50 != 0)
    e = cand - ref
    for r in E.error_slopes(df, "who", "angle", "ref", "cand", 50).collect():
        assert math.isclose(r.estimate, np.polyfit(angle[k], (e if r.metric == "signed_error" else abs(e))[k], 1)[0], rel_tol=1e-6) and r.n_rows == k.sum() and r.n_clusters == 12
    cats = [r.c for r in spark.createDataFrame([(56.0,), (42.0,), (29.0,), (11.0,), (-29.0,), (-30.0,), (None,)], "v double").select(E.skin_category("v").alias("c")).collect()]
    assert cats == ["very_light", "light", "intermediate", "tan", "brown", "dark", None]


def test_design_and_fit_equal_dense_matrices(spark):
    t = np.arange(0, 60, 0.5)
    onsets = {"a": [(3.2, 0.0), (10.25, 0.0), (30.0, 4.0)], "b": [(5.0, 0.0), (5.0, 0.0), (59.9, 0.0)]}
    lag = np.arange(0, 20.25, 0.5)
    kernel = lag**2 * np.exp(-lag / 1.5)
    columns = {}
    for c, events in onsets.items():
        impulse = np.zeros(len(t))
        for on, long in events:
            impulse[(t >= on) & (t <= on + long) if long > 0.5 else np.argmin(abs(t - on))] += 1
        columns[c] = np.convolve(impulse, kernel / kernel.max())[: len(t)]
    y = 2 + 3 * columns["a"] - columns["b"] + np.random.default_rng(2).normal(0, 0.3, len(t))
    samples = spark.createDataFrame([("u", k, float(a), float(b)) for k, (a, b) in enumerate(zip(t, y))] + [(None, k, float(k), 1.0) for k in range(5)], "g string, k long, t double, y double")
    events = spark.createDataFrame([("u", c, on, long) for c, es in onsets.items() for on, long in es] + [("u", "a", None, 0.0), ("other", "a", 1.0, 0.0)], "g string, c string, on double, long double")
    design = D.glm_design(samples, events, ["g"], "t", ["t", "k"], "on", "c", ["a", "b"], "long", derivative=True)
    got = design.where("g = 'u'").orderBy("k").toPandas()
    for c, want in columns.items():
        assert np.allclose(got[f"pspm_{c}"], want) and np.allclose(got[f"pspm_{c}_derivative"], np.r_[0, np.diff(want)] / 0.5)
    fit = D.glm_fit(design, ["g"], "y", ["intercept", "pspm_a", "pspm_b"])
    x = np.column_stack([np.ones(len(t)), columns["a"], columns["b"]])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = ((y - x @ beta) ** 2).sum()
    rows = {r.term: r for r in fit.where("g = 'u'").collect()}
    for k, term in enumerate(("intercept", "pspm_a", "pspm_b")):
        r = rows[term]
        assert math.isclose(r.estimate, beta[k]) and math.isclose(r.std_error, math.sqrt(np.linalg.inv(x.T @ x)[k, k] * rss / 117)) and math.isclose(r.rss, rss) and r.p_value < 1e-6
    flat = fit.where("g is null and term = 'pspm_a'").first()
    assert (flat.estimate, flat.rank, flat.std_error) == (0.0, 1, None)


@pytest.mark.parametrize("t, df, p", [(0.0, 5, 1.0), (2.0, 10, 0.0733880347707), (12.7062047364, 1, 0.05), (0.5, 3, 0.651447964849)])
def test_t_tail(t, df, p):
    assert math.isclose(D._tail(t, df), p, rel_tol=1e-9)
