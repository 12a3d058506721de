"""Registered queries of group comparisons over time and of repaired signals, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import permutation as N, repair as A
from .queries import ORDER, query, samples, table

GROUPS = ("BUILDING", "MACHINERY")


def _courses(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.dayofyear("o_orderdate").alias("day"), "o_totalprice")
    return o.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")


def _cells(spark, d):
    return N.timecourse_cells(_courses(spark, d), "c_custkey", "c_mktsegment", "day", "o_totalprice", GROUPS, 30.0)


@query("timecourse_cells", """with o as (select o_orderkey % 40 subject, o_orderpriority as condition, floor(dayofyear(o_orderdate) / 14.0) * 14 as time, o_totalprice v from orders where o_orderpriority in ('1-URGENT', '5-LOW')),
 c as (select subject, condition, time, median(v) as value from o group by all) select *, count(*) over (partition by subject) = 2 * (select count(distinct time) from c) complete from c""", "time value")
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("subject"), "o_orderpriority", F.dayofyear("o_orderdate").alias("day"), "o_totalprice")
    return N.timecourse_cells(o, "subject", "o_orderpriority", "day", "o_totalprice", ("1-URGENT", "5-LOW"), 14.0, "median")


BETWEEN = """with c as (select c_custkey s, c_mktsegment = 'BUILDING' one, floor(dayofyear(o_orderdate) / 30.0) * 30 m, avg(o_totalprice) v from orders join customer on o_custkey = c_custkey where c_mktsegment in ('BUILDING', 'MACHINERY') group by all),
 o as (select m as time, count(*) filter (one) n_first, count(*) filter (not one) n_second, avg(v) filter (one) - avg(v) filter (not one) difference, (n_first - 1) * var_samp(v) filter (one) + (n_second - 1) * var_samp(v) filter (not one) w from c group by m),
 t as (select time, n_first, n_second, difference, difference / sqrt(w / (n_first + n_second - 2) * (1.0 / n_first + 1.0 / n_second)) t from o)"""
DEALT = BETWEEN + """, p as (select distinct s, one from c), q as (select round, s, row_number() over (partition by round order by ('0x' || substr(md5('1|' || round || '|' || s), 1, 8))::bigint, s) <= (select count(*) from p where one) one from p, range(1, 201) r(round)),
 z as (select round, m, count(*) filter (q.one) a, count(*) filter (not q.one) b, avg(v) filter (q.one) - avg(v) filter (not q.one) f, (a - 1) * var_samp(v) filter (q.one) + (b - 1) * var_samp(v) filter (not q.one) w from c join q using (s) group by round, m),
 y as (select round, m, f / sqrt(w / (a + b - 2) * (1.0 / a + 1.0 / b)) t from z), x as (select *, case when t >= 0.7 then 1 when t <= -0.7 then -1 else 0 end g, row_number() over (partition by round order by m) rn from y),
 k as (select *, rn - row_number() over (partition by round, g order by m) h from x), u as (select round, abs(sum(t)) mass from k where g <> 0 group by round, g, h), null_mass as (select round::int as round, coalesce(max(u.mass), 0) mass from (select distinct round from y) left join u using (round) group by round)"""


@query("between_group_t_map", BETWEEN + " select * from t", "time difference t")
def _(spark, d):
    return N.between_t(_cells(spark, d), GROUPS)


@query("between_permutation_null", DEALT + " select * from null_mass", "mass")
def _(spark, d):
    return N.between_null(_cells(spark, d), GROUPS, 0.7, 200)


@query("between_cluster_p_values", DEALT + """, e as (select *, case when t >= 0.7 then 'positive' when t <= -0.7 then 'negative' end direction, row_number() over (order by time) rn from t), i as (select *, rn - row_number() over (partition by direction order by time) h from e),
 j as (select direction, min(time) as start, max(time) as stop, count(*) size, sum(t) signed_mass, abs(sum(t)) mass from i where direction is not null group by direction, h)
 select j.*, (1 + (select count(*) from null_mass n where n.mass >= j.mass)) / 201.0 p_value, (1 + (select count(*) from null_mass n where n.mass >= j.mass)) / 201.0 <= 0.05 significant from j""", "start stop signed_mass mass p_value")
def _(spark, d):
    cells = _cells(spark, d)
    return N.cluster_p_values(N.clusters(N.between_t(cells, GROUPS), [], "time", 0.7), N.between_null(cells, GROUPS, 0.7, 200))


# --- repaired pupil samples and interval segments ----------------------------

PUPIL = """, v as (select id, unit, t, xm, x - 100 p, case when x > 100 then x - 100 end g from s), c as (select median(g) m, quantile_cont(g, 0.75) - quantile_cont(g, 0.25) q, 1.4826 * mad(g) k from v),
 w as (select v.*, g is null was_invalid, coalesce(abs(p - m) > 1.6 * coalesce(nullif(k, 0), q / 1.349), false) was_spike, row_number() over (partition by unit order by t, id) rn, count(*) over (partition by unit) n from v, c),
 u as (select *, case when not was_spike then g end o from w), h as (select a.id, a.unit, a.rn, a.n, a.was_invalid, a.was_spike, a.o, (select max(rn) from u b where b.unit = a.unit and b.rn <= a.rn and b.o is not null) i, (select min(rn) from u b where b.unit = a.unit and b.rn >= a.rn and b.o is not null) j from u a),
 f as (select h.*, b.o l, e.o r from h left join u b on b.unit = h.unit and b.rn = h.i left join u e on e.unit = h.unit and e.rn = h.j),
 k as (select id, unit, was_invalid, was_spike, case when o is not null then o when coalesce(j, n + 1) - coalesce(i, 0) - 1 <= 4 then coalesce(l + (r - l) * (rn - i) / (j - i), l, r) end clean, o is null and clean is not null was_imputed from f)"""


def _pupil(spark, d):
    return A.clean_pupil(samples(spark, d).withColumn("p", F.col("x") - 100), ["unit"], "p", ORDER, max_gap=4, spike=1.6)


@query("pupil_cleaning", PUPIL + " select id, clean, was_invalid, was_spike, was_imputed from k", "clean")
def _(spark, d):
    return _pupil(spark, d).select("id", "clean", "was_invalid", "was_spike", "was_imputed")


@query("pupil_cleaning_summary", PUPIL + " select unit, count(*) filter (was_invalid) n_invalid_samples, count(*) filter (was_spike) n_spike_samples, count(*) filter (was_imputed) n_imputed_samples, count(*) - count(clean) n_missing_after from k group by unit")
def _(spark, d):
    return A.cleaning_summary(_pupil(spark, d), ["unit"])


@query("interval_segments", """, v as (select id, unit, t, xm * 8 r, floor((t - min(t) over (partition by unit)) / 604800)::bigint + 1 segment_id from s), c as (select *, coalesce(r not between 480 and 2000, true) i, coalesce(abs(r - lag(r) over w) / greatest(abs(lag(r) over w), 1) > 0.6, false) ch from v window w as (partition by unit, segment_id order by t, id)),
 g as (select unit, segment_id, min(t) segment_start_s, max(t) segment_end_s, case when count(t) > 1 then max(t) - min(t) else sum(r) / 1000 end duration_s, count(*) n_beats, count(r) filter (not i and not ch) n_clean_beats, count(*) filter (i or ch) / count(*) artifact_prop, avg(r) filter (not i and not ch) mean_rr_ms,
 median(r) filter (not i and not ch) median_rr_ms, min(r) min_rr_ms, max(r) max_rr_ms, count(*) filter (i) n_implausible_rr, count(*) filter (ch) n_large_successive_changes from c group by all),
 y as (select *, concat_ws(';', case when n_clean_beats < 3 then 'too_few_clean_beats' end, case when coalesce(duration_s < 86400, true) then 'duration_too_short' end, case when artifact_prop > 0.5 then 'high_artifact_prop' end, case when n_implausible_rr > 0 then 'implausible_rr' end, case when n_large_successive_changes > 0 then 'large_successive_change' end) z from g)
 select * exclude (z), z = '' quality_ok, case when z = '' then 'ok' else z end reasons from y""", "segment_start_s segment_end_s duration_s artifact_prop mean_rr_ms median_rr_ms min_rr_ms max_rr_ms")
def _(spark, d):
    s = samples(spark, d).withColumn("rr", F.col("xm") * 8)
    return A.interval_segments(s, ["unit"], "rr", "t", ORDER, 604800.0, 3, 86400.0, 480.0, 2000.0, 0.5, 0.6)
