"""Steps whose cost must not gather in one task or one broadcast: bootstrap draws, fits, pairs of small groups."""

import random

import numpy as np
import pytest

from sensorloom.operators import designs, equity, ranks, standardize, stats
from sensorloom.sources import profiles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_not_broadcast(spark):
    df = spark.range(400).selectExpr("id % 2 as s", "id % 40 as who", "cast(id as double) r", "cast(id * 2 as double) c")
    out = equity.agreement_intervals(df, ["s"], "who", "r", "c", 20)
    text = plan(out)
    assert "strategy=merge" in text and "row_number" not in text
    assert out.count() == 14
    text = plan(equity.error_slopes(df, "who", "r", "r", "c", 20))
    assert "strategy=merge" in text and "row_number" not in text


@pytest.mark.parametrize("small", [0, 20, 512])
def test_small_groups_are_not_multiplied(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)
    rnd = random.Random(2)
    rows = [(g, k, rnd.choice([None, *map(float, range(6))]), rnd.choice([None, 0, 1, 2, 3])) for g, n in ((None, 15), (1, 40), (2**60 + 1, 20), (4, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, k long, x double, y int")
    out = ranks.rank_correlation(df, ["g"], "x", "y", ["k"], 2)
    if small == 512:
        assert "_level" not in plan(out) and "_level" not in plan(ranks.kendall(df, ["g"], "x", "y"))
    got = {r.g: r for r in out.collect()}
    whole = {r.g: r for r in ranks.kendall(df, ["g"], "x", "y").collect()}
    for g in (None, 1, 2**60 + 1):
        x, y = [r[2] for r in rows if r[0] == g], [r[3] for r in rows if r[0] == g]
        taus = {}
        for lag in range(-2, 3):
            p = [(x[i], y[i - lag]) for i in range(len(x)) if 0 <= i - lag < len(x) and x[i] is not None and y[i - lag] is not None]
            s = [((a > c) - (a < c)) * ((b > d) - (b < d)) for i, (a, b) in enumerate(p) for c, d in p[:i]]
            tx, ty = (sum(p[i][z] != q[z] for i in range(len(p)) for q in p[:i]) for z in (0, 1))
            taus[lag] = (sum(s) / (tx * ty) ** 0.5, len(p), sum(v > 0 for v in s), sum(v < 0 for v in s))
        assert (whole[g].n, whole[g].concordant, whole[g].discordant) == taus[0][1:] and whole[g].tau == pytest.approx(taus[0][0])
        best = max(taus, key=lambda k: (round(abs(taus[k][0]), 12), -k))
        assert got[g].correlation == pytest.approx(taus[0][0]) and got[g].n == taus[0][1]
        assert got[g].best_lag == best and got[g].best_lag_correlation == pytest.approx(taus[best][0])
    assert got[4].correlation is None and got[4].best_lag is None



def test_fits_leave_groups_spread(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 4.0), (None, 3.0, 5.0), (1, 5.0, 1.0), (2, None, 1.0)], "g long, x double, y double")
    out = standardize.linear_residual(df, ["g"], "y", "x")
    assert "Window" not in plan(out)
    got = {(r.g, r.x): (r.residual, r.fit_mean) for r in out.collect()}
    assert got[1, 5.0] == (1.0, 1.0) and got[2, None] == (None, None)
    assert got[None, 1.0] == pytest.approx((2.0 + 1.5, 11 / 3)) and got[None, 3.0] == pytest.approx((5.0 - 1.5, 11 / 3))


def test_bootstrap_weights_take_one_digest_a_round(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], float(k * k % 13)) for k in range(60)], "id long, c string, x double")
    out = stats.bootstrap_difference(df, [], "c", "x", ("a", "b"), 20, "id")
    text = plan(out)
    assert "RepartitionByExpression" in text and "conv(" not in text
    assert out.first().diff == pytest.approx(np.mean([k * k % 13 for k in range(1, 60, 2)]) - np.mean([k * k % 13 for k in range(0, 60, 2)]))


def test_fits_of_many_groups_take_no_call_a_group(spark):
    rnd = random.Random(1)
    rows = [(g, 1.0, rnd.random(), rnd.random(), rnd.random()) for g in (None, 1, 2**60 + 1) for _ in range(12)] + [(5, 1.0, 2.0, 4.0, float(k)) for k in range(4)]
    df = spark.createDataFrame(rows, "g long, one double, a double, b double, y double")
    out = designs.glm_fit(df, ["g"], "y", ["one", "a", "b"])
    assert "InPandas" not in plan(out) and "Join" not in plan(out)
    got = {(r.g, r.term): r for r in out.collect()}
    assert len(got) == 12 and got[5, "a"]["rank"] == 1 and got[5, "a"].std_error is None
    for g in (None, 1, 2**60 + 1):
        m = np.array([r[1:] for r in rows if r[0] == g])
        beta, rss, _, _ = np.linalg.lstsq(m[:, :3], m[:, 3], rcond=None)
        for k, term in enumerate(("one", "a", "b")):
            r = got[g, term]
            assert r.estimate == pytest.approx(beta[k]) and r.rss == pytest.approx(rss[0]) and 0 <= r.p_value <= 1


def test_lines_do_not_gather_by_file(spark, tmp_path):
    for name, lines in {"a.csv": ["GSR;label", "1;x", "1.0;x", "NA;y", "2;"], "b.csv": ["TIME", "0", "0"]}.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    out = profiles.profile_folder(spark, str(tmp_path))["columns"]
    assert "strategy=broadcast" in plan(out) and "Expand" not in plan(out)
    got = {r.column: (r.type, r.n_rows, r.n_missing, r.n_unique, r.all_zero, r.constant) for r in out.collect()}
    assert got == {"GSR": ("numeric", 4, 1, 2, False, False), "label": ("character", 4, 1, 2, False, False), "TIME": ("numeric", 2, 0, 1, True, True)}
