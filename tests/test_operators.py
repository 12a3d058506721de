"""Operators on small literal tables: ties, missing values, empty tables, edges."""

import math

import numpy as np

from sensorloom.operators import cardiac as C, complexity as Y, events as E, joins as J, quality as Q, standardize as S, stats as T, windows as W


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_windows_skip_zero_and_missing(spark):
    df = frame(spark, [("a", 1, 0.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 4.0)], "g string, i int, x double")
    r = W.signal_windows(df, ["g"], "x", ["i"]).first()
    assert (r.n_rows, r.usable_rows, r["mean"], r["first"], r["last"], r.change) == (4, 2, 3.0, 2.0, 4.0, 2.0)
    assert W.signal_windows(df.limit(0), ["g"], "x", ["i"]).count() == 0


def test_zscore_statuses(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 1.0), ("c", 1.0), ("c", 2.0), ("c", 3.0)], "g string, x double")
    got = {(r.g, r.z_status) for r in S.zscore(df, ["g"], "x").collect()}
    assert got == {("a", "zero_sd"), ("b", "too_few"), ("c", "ok")}


def test_impute_respects_the_longest_gap(spark):
    df = frame(spark, [("a", float(i), x) for i, x in enumerate([1.0, None, 3.0, None, None, 6.0, None])], "g string, t double, x double")
    got = [r.imputed for r in S.impute(df, ["g"], "x", "t", ["t"], "linear", 1).orderBy("t").collect()]
    assert got == [1.0, 2.0, 3.0, None, None, 6.0, None]


def test_resets_and_ties(spark):
    df = frame(spark, [("a", i, t) for i, t in enumerate([1.0, 2.0, 2.0, 1.0, 2.0])], "g string, i int, t double")
    rows = S.time_resets(df, ["g"], "t", ["i"]).orderBy("i").collect()
    assert [r.segment for r in rows] == [0, 0, 0, 1, 1] and [r.is_tie for r in rows] == [False, False, True, False, False]


def test_null_keys_match_in_sync(spark):
    a = frame(spark, [(None, 1), ("x", 2)], "k string, v int")
    b = frame(spark, [(None, 10), ("x", 20), ("y", 30)], "k string, w int")
    assert {(r.k, r.w) for r in J.sync(a, b, ["k"], ["w"]).collect()} == {(None, 10), ("x", 20)}


def test_nearest_takes_the_earlier_on_ties(spark):
    a = frame(spark, [("g", 1, 5.0), ("g", 2, 100.0)], "k string, id int, t double")
    b = frame(spark, [("g", 1, 4.0, 1.0), ("g", 2, 6.0, 2.0)], "k string, id int, t double, x double")
    assert [r.match_x for r in J.nearest(a, b, ["k"], "t", "id", "x", 3.0).orderBy("id").collect()] == [1.0, None]


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    e = [("g%d" % rng.integers(3), int(k), float(rng.uniform(0, 100))) for k in range(30)]
    s = [("g%d" % rng.integers(3), int(k), float(rng.uniform(0, 100))) for k in range(200)]
    got = J.align_to_events(frame(spark, e, "g string, event int, et double"), frame(spark, s, "g string, id int, t double"), ["g"], "et", "t", 3.0, 5.0)
    want = sorted((a[1], b[1]) for a in e for b in s if a[0] == b[0] and a[2] - 3 <= b[2] <= a[2] + 5)
    assert sorted((r.event, r.id) for r in got.collect()) == want


def test_dropouts(spark):
    df = frame(spark, [("a", i, x) for i, x in enumerate([1.0, None, None, 2.0, 2.0, 2.0, 3.0])], "g string, i int, x double")
    rows = Q.dropouts(df, ["g"], "x", ["i"], 2, 2).orderBy("i").collect()
    assert [r.missing_dropout for r in rows] == [False, True, True, False, False, False, False]
    assert [r.flat_dropout for r in rows] == [False, False, False, False, True, True, False]


def test_fixations_split_at_a_jump(spark):
    pts = [(0, 0.0), (1, 0.0), (2, 0.0), (3, 50.0), (4, 50.0), (5, 50.0)]
    df = frame(spark, [("a", float(t), x, 0.0) for t, x in pts], "g string, t double, x double, y double")
    r = E.fixations(df, ["g"], "x", "y", "t", ["t"], 1.0, 10.0, 1.0).orderBy("start").collect()
    assert [(f.start, f.stop) for f in r] == [(0.0, 1.0), (4.0, 5.0)]


def test_hrv_time_domain(spark):
    x = [800.0, 810.0, 790.0, 860.0]
    r = C.time_domain(frame(spark, [("a", i, v) for i, v in enumerate(x)], "g string, i int, x double"), ["g"], "x", ["i"]).first()
    d = np.diff(x)
    assert math.isclose(r.rmssd, math.sqrt((d**2).mean())) and math.isclose(r.sdnn, np.std(x, ddof=1)) and r.nn50 == 1


def series(spark, x):
    return spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(x)], "g string, k long, x double")


def test_sample_entropy_of_a_constant_is_undefined(spark):
    entropy = lambda x: Y.sample_entropy(series(spark, x), ["g"], "x", ["k"]).first().entropy
    assert entropy(np.ones(30)) is None
    assert entropy(np.sin(np.arange(300) / 5)) < entropy(np.random.default_rng(1).normal(size=300))


def test_dfa_of_noise_is_near_one_half(spark):
    assert abs(Y.detrended_fluctuation(series(spark, np.random.default_rng(2).normal(size=4000)), ["g"], "x", ["k"]).first().dfa - 0.5) < 0.12


def test_cluster_null_is_repeatable(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, [(s, c, t, float(rng.normal())) for s in range(6) for c in "ab" for t in range(8)], "s int, c string, t int, x double")
    a, b = (sorted(tuple(r) for r in T.cluster_null(df, "s", "c", "t", "x", ("a", "b"), 1.0, 10).collect()) for _ in range(2))
    assert a == b and len(a) == 10


def test_area_priority(spark):
    p = frame(spark, [(1, 5.0, 5.0), (2, 50.0, 50.0), (3, None, 1.0)], "i int, x double, y double")
    a = frame(spark, [("big", 0.0, 20.0, 0.0, 20.0, 1), ("top", 4.0, 6.0, 4.0, 6.0, 2)], "aoi string, xmin double, xmax double, ymin double, ymax double, priority int")
    assert {r.i: r.area for r in J.assign_area(p, a, "x", "y").collect()} == {1: "top", 2: None, 3: None}


def test_fusion_and_ema_equal_a_plain_loop(spark):
    import random

    from sensorloom.operators import scans

    rnd = random.Random(5)
    rows = [(u, float(k), k % 7, rnd.gauss(5, 2) if rnd.random() < 0.6 else None, rnd.gauss(5, 1) if rnd.random() < 0.4 else None) for u in "abc" for k in range(90)]
    rows += [("d", float(k), k, None, None) for k in range(5)] + [(None, 1.0, 1, 2.0, None), (None, 2.0, 1, None, 3.0)]
    df = spark.createDataFrame(rows, "u string, t double, _a long, p double, s double").repartition(5)

    def plain(mine):
        state, var, out = None, 1.0, []
        for _, t, _, p, s in sorted(mine, key=lambda r: r[1]):
            var += 0.01
            for z, r in ((p, 0.05), (s, 0.2)):
                if z is not None:
                    state = z if state is None else state
                    gain = var / (var + r)
                    state, var = state + gain * (z - state), (1 - gain) * var
            out.append((t, state, var))
        return out

    d = df.drop("_a")
    for width in (7.0, 1000.0):
        got = scans.fuse_two(d, ["u"], "p", "s", ["t"], width, 0.01, 0.05, 0.2).collect()
        for u in ("a", "b", "c", "d", None):
            mine = sorted((r.t, r.fused, r.variance) for r in got if r.u == u) if u else sorted((r.t, r.fused, r.variance) for r in got if r.u is None)
            if u is None:
                assert len(mine) == 2
                continue
            for a, b in zip(mine, plain([r for r in rows if r[0] == u])):
                assert a[0] == b[0] and abs(a[2] - b[2]) < 1e-9 and (a[1] is None) == (b[1] is None) and (a[1] is None or abs(a[1] - b[1]) < 1e-9)
    got = {(r.u, r.t): r.ema for r in scans.adaptive_ema(d, ["u"], "p", ["t"], 10.0, 0.2, 100.0).collect()}
    for u in "abcd":
        m = None
        for _, t, _, p, _ in sorted((r for r in rows if r[0] == u), key=lambda r: r[1]):
            m = m if p is None else p if m is None else 0.8 * m + 0.2 * p
            assert (got[u, t] is None) == (m is None) and (m is None or abs(got[u, t] - m) < 1e-9)


def test_refractory_equals_a_plain_loop(spark):
    import random

    from sensorloom.operators import scans

    rnd = random.Random(6)
    rows = [(u, round(rnd.uniform(0, 60), 2)) for u in "ab" for _ in range(80)] + [("a", 5.0), ("a", 5.0), ("c", None)]
    got = sorted((r.u, r.t) for r in scans.refractory(spark.createDataFrame(rows, "u string, t double"), ["u"], "t", 1.5).collect())
    want = []
    for u in "ab":
        last = None
        for t in sorted(t for v, t in rows if v == u):
            if last is None or t - last >= 1.5:
                want.append((u, t))
                last = t
    assert got == want


def test_equal_points_stay_apart(spark):
    areas = spark.createDataFrame([("one", 0.0, 2.0, 0.0, 2.0, 1)], "aoi string, xmin double, xmax double, ymin double, ymax double, priority int")
    p = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (5.0, 1.0), (None, 1.0)], "x double, y double")
    assert sorted((r.area or "", r.n_areas) for r in J.assign_area(p, areas, "x", "y").collect()) == [("", 0), ("", 0), ("one", 1), ("one", 1)]
    assert J.assign_area(p, areas.limit(0), "x", "y").count() == 4


def test_rank_test_corrects_for_ties(spark):
    rows = [("g", "a", v) for v in (1.0, 2.0, 2.0, 3.0)] + [("g", "b", v) for v in (2.0, 4.0, 4.0, 5.0)] + [("same", c, 1.0) for c in "aabb"]
    got = {r.k: r.h for r in T.kruskal(spark.createDataFrame(rows, "k string, c string, x double"), ["k"], "c", "x").collect()}
    ranks = {1.0: 1, 2.0: 3, 3.0: 5, 4.0: 6.5, 5.0: 8}
    a, b = sum(ranks[v] for v in (1.0, 2.0, 2.0, 3.0)), sum(ranks[v] for v in (2.0, 4.0, 4.0, 5.0))
    h = 12 / (8 * 9) * (a * a / 4 + b * b / 4) - 3 * 9
    assert abs(got["g"] - h / (1 - (27 - 3 + 8 - 2) / (512 - 8))) < 1e-9 and got["same"] is None
