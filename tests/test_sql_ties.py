"""Queries and their SQL on recordings made of ties: sums on borders, means halfway between two results, intervals of 0."""

import pytest

from sensorloom.plans import queries as q

from .compare import connect


def agrees(spark, folder, name, values):
    """Both sides in full digits; ``values`` is (unit, value) in the order of time."""
    rows = [(k, k * 86400, u, "view", float(v)) for k, (u, v) in enumerate(values)]
    d = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    d.selectExpr("event_id", "timestamp_seconds(1704067200 + s) ts", "user_id", "event_type", "value", "'' props").coalesce(1).write.parquet(f"{folder}/w")
    (part,) = folder.glob("w/*.parquet")
    part.rename(folder / "events.parquet")
    df = q.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    cur = connect(str(folder)).execute(q.SQL[name])
    at = [c[0] for c in cur.description]
    want = sorted(map(repr, (tuple(r[at.index(c)] for c in names) for r in cur.fetchall())))
    assert got == want
    return df.collect()


def test_an_interval_of_zero_before_is_no_abrupt_change(spark, tmp_path):
    found = agrees(spark, tmp_path, "beat_audit", [(1, 50), (1, 0), (1, 60), (1, 0), (1, 0), (1, 200)])
    assert [r.reasons for r in sorted(found, key=lambda r: r.id)] == ["", "range", "", "range", "range", ""]


@pytest.mark.parametrize("name", ["sliding_segments", "hrv_segment_indices"])
def test_sums_on_borders_and_means_between_results(spark, tmp_path, name):
    tenths = [(u, v) for u in range(40) for v in [0.1 * (u % 7 + 1), 33.33, 66.67 - 0.1 * (u % 7 + 1), 50.01, 49.99] * 20]
    halfway = [(100 + u, v) for u in range(40) for v in [28.11 + u / 100, 0.37, 61.03, 12.4] * 8]
    found = agrees(spark, tmp_path, name, tenths + halfway)
    if name == "sliding_segments":
        assert {r.segment for r in found if r.unit == 1} == set(range(4)), "sums of 1000, 2000, 3000 and 4000 lie on borders"


def test_segments_beyond_two_hundred(spark, tmp_path):
    found = agrees(spark, tmp_path, "sliding_segments", [(1, 250.5)] * 1000)
    assert max(r.segment for r in found) == 249


def test_beats_at_their_average_and_equal_spreads(spark, tmp_path):
    series = [(u, round(v + 0.1 * (u % 9), 2)) for u in range(30) for v in [1.1, 2.3, 2.3, 2.3, 2.3, 2.3, 2.3, 2.3, 3.5, 1.7, 9.2, 0.4] * 6]
    agrees(spark, tmp_path, "pulse_beats", series)


def cents(values):
    """Recordings of 64 samples whose sum in cents is 2 more than a multiple of 4: their mean is halfway between two results of six digits."""
    return [(u, (v - (sum(vs) - 2) % 4 if k == 0 else v) / 100) for u, vs in values for k, v in enumerate(vs)]


def test_window_means_halfway_do_not_depend_on_the_cut_into_tasks(spark, tmp_path, monkeypatch):
    read = q.samples
    monkeypatch.setattr(q, "samples", lambda spark, d: read(spark, d).repartition(7, "id"))
    agrees(spark, tmp_path, "windows_multimodal", cents([(u, [100 + (7919 * u + 3571 * k * k) % 12000 for k in range(64)]) for u in range(120)]))


def test_window_means_halfway_round_as_in_the_sql(spark, tmp_path):
    agrees(spark, tmp_path, "windows_multimodal", cents([(u, [3210 + u] * 64) for u in range(120)] + [(200 + u, [6400 + u] * 64) for u in range(120)]))


def test_last_sample_of_a_window_may_be_zero(spark, tmp_path):
    found = agrees(spark, tmp_path, "windows_multimodal", [(1, 5), (1, 70), (1, 0), (2, 0), (3, 80)])
    assert {r.unit: (r.a_usable, r.a_last, r.b_last) for r in found} == {1: (2, 0.0, 70.0), 2: (0, 0.0, None), 3: (1, 80.0, 80.0)}
