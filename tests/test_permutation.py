"""Cluster permutation of two groups against plain formulas; cells with missing and repeated values."""

import numpy as np
import pytest

from sensorloom.operators import permutation as N

LEVELS = ("a", "b")


@pytest.fixture(scope="module")
def courses(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", "a" if k < 6 else "b", float(t), float(rng.normal() + (2.5 if k < 6 and 3 <= t <= 6 else 0))) for k in range(13) for t in range(10) if (k, t) != (2, 9)]
    return spark.createDataFrame(rows, "p string, c string, t double, x double").repartition(3)


def test_t_equals_the_two_sample_formula(courses):
    got = {r.time: r for r in N.between_t(N.timecourse_cells(courses, "p", "c", "t", "x", LEVELS), LEVELS).collect()}
    rows = [tuple(r) for r in courses.collect()]
    for t in range(10):
        a, b = (np.array([x for _, c, u, x in rows if c == g and u == t]) for g in LEVELS)
        pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
        assert (got[t].n_first, got[t].n_second) == (len(a), len(b))
        assert np.isclose(got[t].t, (a.mean() - b.mean()) / np.sqrt(pooled * (1 / len(a) + 1 / len(b))))


def test_a_planted_effect_is_the_significant_cluster(courses):
    cells = N.timecourse_cells(courses, "p", "c", "t", "x", LEVELS)
    null = N.between_null(cells, LEVELS, 2.2, 200)
    best = max(N.cluster_p_values(N.clusters(N.between_t(cells, LEVELS), [], "time", 2.2), null).collect(), key=lambda r: r.mass)
    assert best.direction == "positive" and best.start <= 4 and best.stop >= 5 and best.p_value < 0.03 and best.significant
    assert null.count() == 200 and sorted(null.collect()) == sorted(N.between_null(cells, LEVELS, 2.2, 200).collect())


def test_labels_keep_group_sizes(courses):
    # a unit value for the first group's members and 0 for others would vary with the sizes; equal values give t 0 and no cluster
    same = courses.selectExpr("p", "c", "t", "1.0D x")
    cells = N.timecourse_cells(same, "p", "c", "t", "x", LEVELS)
    assert {r.t for r in N.between_t(cells, LEVELS).collect()} == {0.0}
    assert {r.mass for r in N.between_null(cells, LEVELS, 0.1, 20).collect()} == {0.0}


def test_tails_and_borders(spark):
    tmap = spark.createDataFrame([(k, float(v)) for k, v in enumerate([2, 3, -2, -4, 0, 2])], "time int, t double")
    two = sorted((r.direction, r.start, r.stop, r.signed_mass) for r in N.clusters(tmap, [], "time", 2.0).collect())
    assert two == [("negative", 2, 3, -6.0), ("positive", 0, 1, 5.0), ("positive", 5, 5, 2.0)]  # reaching the limit counts
    assert [r.mass for r in N.clusters(tmap, [], "time", 2.0, "negative").collect()] == [6.0]
    with pytest.raises(ValueError):
        N.clusters(tmap, [], "time", 2.0, "both")


def test_cells_of_bins_missing_values_and_members_of_both(spark):
    nan = float("nan")
    rows = [("p", "a", 0.5, 1.0), ("p", "a", 1.5, 2.0), ("p", "a", 1.9, 6.0), ("p", "b", 0.0, 4.0), ("p", "b", 2.0, 5.0), ("q", "a", 0.0, 1.0), ("q", "z", 1.0, 9.0), (None, "a", 0.0, 1.0), ("q", "a", nan, 1.0), ("q", None, 0.0, 1.0), ("q", "a", 2.0, None)]
    df = spark.createDataFrame(rows, "p string, c string, t double, x double")
    cells = N.timecourse_cells(df, "p", "c", "t", "x", LEVELS, 2.0)
    assert sorted(tuple(r) for r in cells.collect()) == [("p", "a", 0.0, 3.0, False), ("p", "b", 0.0, 4.0, False), ("p", "b", 2.0, 5.0, False), ("q", "a", 0.0, 1.0, False)]
    assert {r.value for r in N.timecourse_cells(df, "p", "c", "t", "x", LEVELS, 2.0, "median").where("subject = 'p' and condition = 'a'").collect()} == {2.0}
    assert [tuple(r) for r in N.group_members(cells, LEVELS).collect()] == [("q", True)]
    assert N.between_null(N.timecourse_cells(df.limit(0), "p", "c", "t", "x", LEVELS), LEVELS, 1.0, 5).count() == 0
    full = N.timecourse_cells(df.where("p = 'p' and t < 2"), "p", "c", "t", "x", LEVELS, 2.0)
    assert all(r.complete for r in full.collect())
    for bad in ({"width": 0.0}, {"centre": "mode"}):
        with pytest.raises(ValueError):
            N.timecourse_cells(df, "p", "c", "t", "x", LEVELS, **bad)
