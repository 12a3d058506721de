"""Registered queries of the tile, rank, pyramid, bootstrap and design operators, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ranges import kept
from ..operators import cleaning as C, designs as D, equity as E, pyramids as P, ranks as K, streams as M, tiles as G
from ..sources import profiles as X
from .queries import ORDER, query, samples

# --- recurrence by tiles -----------------------------------------------------

RQA = """, v as (select unit, x, row_number() over w - 1 rn, lead(x) over w y from s where x > 0 window w as (partition by unit order by t, id)), k as (select unit, count(*) filter (x > 0) n_intervals from s group by unit),
 e as (select v.* from v join k using (unit) where y is not null and n_intervals >= 9), a as (select unit, x z from e union all select unit, y from e), r as (select unit, greatest(0.2 * stddev_samp(z), pow(2, -52)) rad from a group by unit),
 p as (select a.unit, a.rn i, b.rn j from e a join e b on a.unit = b.unit join r on r.unit = a.unit where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= rad),
 d as (select unit, count(*) len from (select unit, j - i g, i - row_number() over (partition by unit, j - i order by i) h from p) group by unit, g, h),
 w as (select unit, count(*) len from (select unit, j g, i - row_number() over (partition by unit, j order by i) h from p) group by unit, g, h),
 q as (select unit, len, count(*) c from d where len >= 2 group by unit, len), en as (select unit, entropy(len::varchar) * ln(2) diagonal_entropy from (select unit, len from d where len >= 2) group by unit),
 f as (select unit, count(*) points from p group by unit), dd as (select unit, sum(len) filter (len >= 2) de, avg(len) filter (len >= 2) mean_diagonal_length, max(len) longest_diagonal from d group by unit), vv as (select unit, sum(len) filter (len >= 2) ve, avg(len) filter (len >= 2) trapping_time from w group by unit)
 select k.unit, n_intervals, points / ((n_intervals - 1.0) * (n_intervals - 1.0)) recurrence_rate, coalesce(de, 0) / points::double determinism, coalesce(ve, 0) / points::double laminarity, trapping_time, diagonal_entropy, mean_diagonal_length, longest_diagonal,
 case when points is null then 'insufficient_intervals' else 'hrv_rqa_extracted' end status from k left join f using (unit) left join dd using (unit) left join vv using (unit) left join en using (unit)"""


@query("hrv_rqa", RQA, "recurrence_rate determinism laminarity trapping_time diagonal_entropy mean_diagonal_length")
def _(spark, d):
    return G.recurrence_quantification(samples(spark, d), ["unit"], "x", ORDER)


@query("hrv_rcmse", """, v as (select unit, x, row_number() over (partition by unit order by t, id) - 1 rn from s where x > 0), k as (select unit, count(*) filter (x > 0) n, stddev_samp(x) filter (x > 0) sd from s group by unit),
 g as (select unit, scale, n, sd from k, (select unnest([1, 2, 3]) scale)), o as (select g.*, unnest(range(scale)) o from g where n >= 20 and sd > 0),
 c as (select o.unit, o.scale, o.o, (v.rn - o.o) // o.scale b, avg(v.x) m, any_value(0.2 * sd) tol, any_value((n - o.o) // o.scale) boxes from o join v on v.unit = o.unit and v.rn >= o.o group by o.unit, o.scale, o.o, (v.rn - o.o) // o.scale),
 e as (select *, lead(m) over w m2, lead(m, 2) over w m3 from c where b < boxes and boxes >= 4 window w as (partition by unit, scale, o order by b)),
 f as (select a.unit, a.scale, count(*) match_count_m, count(*) filter (abs(a.m3 - z.m3) <= a.tol) match_count_m1 from e a join e z on a.unit = z.unit and a.scale = z.scale and a.o = z.o and a.b < z.b where abs(a.m - z.m) <= a.tol and abs(a.m2 - z.m2) <= a.tol group by a.unit, a.scale),
 h as (select g.unit, g.scale, n >= 20 and coalesce(sd, 1) <> 0 ok, match_count_m, match_count_m1 from g left join f using (unit, scale)), r as (select unit, scale, ok, case when ok then coalesce(match_count_m, 0) end match_count_m, case when ok then coalesce(match_count_m1, 0) end match_count_m1, case when match_count_m > 0 and match_count_m1 > 0 then -ln(match_count_m1 / match_count_m::double) end rcmse from h)
 select unit, scale, match_count_m, match_count_m1, rcmse, case when not ok then 'insufficient_intervals' when rcmse is null then 'rcmse_not_estimated' else 'rcmse_extracted' end status from r""", "rcmse")
def _(spark, d):
    return G.refined_multiscale_entropy(samples(spark, d), ["unit"], "x", ORDER, (1, 2, 3))


# --- Kendall -----------------------------------------------------------------

KENDALL = """p as (select a.g, sum(case when sign(b.x - a.x) * sign(b.y - a.y) > 0 then 1 else 0 end) c, sum(case when sign(b.x - a.x) * sign(b.y - a.y) < 0 then 1 else 0 end) d, count(*) n0, sum((a.x = b.x)::int) tx, sum((a.y = b.y)::int) ty from q a join q b on a.g = b.g and a.rn < b.rn group by a.g),
 tau as (select g, n, coalesce(c, 0)::bigint concordant, coalesce(d, 0)::bigint discordant, case when n >= 3 and n0 > tx and n0 > ty then (c - d) / (sqrt(n0 - tx) * sqrt(n0 - ty)) end tau from (select g, count(*) n from q group by g) left join p using (g))"""


@query("kendall_correlation", ", q as (select unit g, round(x) x, h y, row_number() over (partition by unit order by id) rn from s), " + KENDALL + " select g as unit, n, concordant, discordant, tau from tau", "tau")
def _(spark, d):
    return K.kendall(samples(spark, d).withColumn("r", F.round("x")), ["unit"], "r", "h")


@query("kendall_by_state", ", q as (select state g, xm x, h::double y, row_number() over (partition by state order by id) rn from s where xm is not null), " + KENDALL + " select g as state, n, concordant, discordant, tau from tau", "tau")
def _(spark, d):
    return K.kendall(samples(spark, d), ["state"], "xm", "h")


@query("kendall_best_lag", ", l as (select unit, x, k, case when k >= 0 then lag(h, abs(k)) over w else lead(h, abs(k)) over w end y, id from s, (select unnest(range(-2, 3))::int k) window w as (partition by unit, k order by t, id)), q as (select unit || '|' || k g, x, y, row_number() over (partition by unit, k order by id) rn from l where x is not null and y is not null), "
       + KENDALL + """, z as (select split_part(g, '|', 1)::bigint unit, split_part(g, '|', 2)::int k, n, tau from tau), b as (select unit, max(n) filter (k = 0) n, max(tau) filter (k = 0) correlation, arg_max(k, (round(abs(tau), 12), -k)) filter (tau is not null) best_lag, arg_max(tau, (round(abs(tau), 12), -k)) filter (tau is not null) best_lag_correlation from z group by unit)
 select u.unit, coalesce(n, 0) n, correlation, best_lag, best_lag_correlation from (select distinct unit from s) u left join b using (unit)""", "correlation best_lag_correlation")
def _(spark, d):
    return K.rank_correlation(samples(spark, d), ["unit"], "x", "h", ORDER, 2)


# --- pyramids ----------------------------------------------------------------

PSD = """, l as (select unit, list(x order by t, id) xs, count(x) n, median(x) med from s where x is not null group by unit having count(x) >= 8), u as (select unit, n, case when med > 10 then med / 1000 else med end med, case when med > 10 then list_transform(xs, lambda v: v / 1000) else xs end xs from l),
 g as (select *, unnest(list_transform(range(floor(log2(greatest(2, n // 4)))::bigint + 1), lambda e: (2 ** e)::bigint)) s from u), k as (select unit, s, med, unnest(range(1, n - 2 * s + 2)) k, xs from g),
 c as (select unit, s, med, list_avg(xs[k:k + s - 1]) - list_avg(xs[k + s:k + 2 * s - 1]) c from k), psd as (select unit, s scale_beats, case when any_value(med) > 0 then 1 / (2 * s * any_value(med)) end pseudo_frequency_hz, 2 * s period_beats, count(*) n_coefficients, avg(c * c) / 2 wavelet_power from c group by unit, s)"""


@query("hrv_wavelet_psd", PSD + " select * from psd", "pseudo_frequency_hz wavelet_power")
def _(spark, d):
    return P.wavelet_power(samples(spark, d), ["unit"], "x", ORDER)


@query("hrv_wavelet_bands", PSD + """, b as (select * from (values ('vlf', 0.5::double, 1.0::double), ('lf', 1.0::double, 3.0::double), ('hf', 3.0::double, 30.0::double)) b(band, low_hz, high_hz))
 select unit, band, low_hz, high_hz, count(*) filter (pseudo_frequency_hz >= low_hz and pseudo_frequency_hz < high_hz) n_scales, coalesce(sum(wavelet_power) filter (pseudo_frequency_hz >= low_hz and pseudo_frequency_hz < high_hz), 0) band_power from psd, b group by unit, band, low_hz, high_hz""", "low_hz high_hz band_power")
def _(spark, d):
    bands = {"vlf": (0.5, 1.0), "lf": (1.0, 3.0), "hf": (3.0, 30.0)}
    return P.band_power(P.wavelet_power(samples(spark, d), ["unit"], "x", ORDER), ["unit"], bands)


@query("eda_wavelet_denoise", """, a as (select id, unit, xm, row_number() over w pos, count(*) over (partition by unit) n, count(xm) over (partition by unit) k, last_value(case when xm is not null then xm end ignore nulls) over w p, last_value(case when xm is not null then row_number end ignore nulls) over w pa,
  first_value(xm ignore nulls) over (partition by unit order by t, id rows between current row and unbounded following) f, first_value(case when xm is not null then row_number end ignore nulls) over (partition by unit order by t, id rows between current row and unbounded following) fa
  from (select *, row_number() over (partition by unit order by t, id) row_number from s) window w as (partition by unit order by t, id)),
 z as (select *, coalesce(xm, p + (f - p) * (pos - pa) / nullif(fa - pa, 0)::double, p, f) z from a), st as (select *, z - lag(z) over (partition by unit order by pos) step from z), sg as (select unit, mad(step) / 0.6745 sd from st group by unit),
 b as (select st.*, case when k >= 8 then case when sd > 0 then sd * sqrt(2 * ln(n)) else 0 end end thr, (z + 3 * coalesce(lag(z, 1) over w, first_value(z) over w) + 3 * coalesce(lag(z, 2) over w, first_value(z) over w) + coalesce(lag(z, 3) over w, first_value(z) over w)) / 8 sm from st join sg using (unit) window w as (partition by unit order by pos))
 select id, case when xm is not null and k >= 8 then sm + sign(z - sm) * greatest(abs(z - sm) - thr, 0) end denoised, thr threshold, case when k >= 8 then 'wavelet_denoised' else 'insufficient_finite_samples' end denoise_status from b""", "denoised threshold")
def _(spark, d):
    return P.denoise(samples(spark, d), ["unit"], "xm", ORDER).select("id", "denoised", "threshold", "denoise_status")


# --- agreement with cluster bootstrap ------------------------------------------

PAIRS = ", d as (select state, case when unit % 10 <> 0 then unit end who, x r, case when xm is not null then xm * 1.02 + h / 10.0 end c, h * 3 - 20.0 angle from s)"
METRICS = """n / nullif(refs, 0)::double retention_rate, d / nullif(n, 0) bias, ad / nullif(n, 0) mae, sqrt(dd / nullif(n, 0)) rmse, d / nullif(n, 0) - 1.96 * sqrt(greatest(dd - d * d / nullif(n, 0), 0) / nullif(n - 1, 0)) loa_lower, d / nullif(n, 0) + 1.96 * sqrt(greatest(dd - d * d / nullif(n, 0), 0) / nullif(n - 1, 0)) loa_upper,
 2 * (rc - r * c / n) / nullif(n - 1, 0) / nullif((rr - r * r / n + cc - c * c / n) / nullif(n - 1, 0) + ((r - c) / n) ** 2, 0) lin_ccc"""
SUMS = "count(*) as rows, count(r) refs, count(c) n, sum(c - r) d, sum((c - r) ** 2) dd, sum(abs(c - r)) ad, sum(r) filter (c is not null) r, sum(c) c, sum(r * r) filter (c is not null) rr, sum(c * c) cc, sum(r * c) rc"
TOTALS = ", ".join(f"sum(m * {c}) {c}" for c in ("refs", "n", "d", "dd", "ad", "r", "c", "rr", "cc", "rc"))
DRAWS = "(('0x' || substr(md5(concat_ws('|', '1', round, slot{more})), 1, 8))::bigint % g)"


def _pairs(spark, d):
    s = samples(spark, d)
    return s.select("state", F.when(F.col("unit") % 10 != 0, F.col("unit")).alias("who"), F.col("x").alias("r"), (F.col("xm") * 1.02 + F.col("h") / 10).alias("c"), (F.col("h") * 3 - 20).cast("double").alias("angle"))


@query("agreement_cluster_bootstrap", PAIRS + f""", pm as (select state, who, {SUMS} from d group by state, who), w as (select *, row_number() over (partition by state order by who) - 1 slot, count(*) over (partition by state) g from pm where who is not null),
 dr as (select state, round, {DRAWS.format(more=", state")} pick from w, range(1, 101) r(round) where g >= 2), b as (select dr.state, round, {TOTALS} from (select state, round, pick, count(*) m from dr group by all) dr join w on w.state = dr.state and w.slot = dr.pick group by dr.state, round),
 t as (select state, {', '.join(f'sum({c}) {c}' for c in ('refs', 'n', 'd', 'dd', 'ad', 'r', 'c', 'rr', 'cc', 'rc'))} from pm group by state),
 e as (unpivot (select state, {METRICS} from t) on columns(* exclude state) into name metric value estimate), f as (unpivot (select state, round, {METRICS} from b) on columns(* exclude (state, round)) into name metric value v)
 select e.state, e.metric, estimate, quantile_cont(v, 0.025) ci_low, quantile_cont(v, 0.975) ci_high from e left join f using (state, metric) group by all""", "estimate ci_low ci_high")
def _(spark, d):
    return E.agreement_intervals(_pairs(spark, d), ["state"], "who", "r", "c", 100)


@query("agreement_by_skin_category", PAIRS + f""", q as (select *, case when angle > 55 then 'very_light' when angle > 41 then 'light' when angle > 28 then 'intermediate' when angle > 10 then 'tan' when angle > -30 then 'brown' else 'dark' end pigmentation_category from d),
 t as (select state, pigmentation_category, count(distinct who) n_participants, {SUMS} from q group by state, pigmentation_category) select state, pigmentation_category, rows n_rows, n_participants, refs reference_available, n n_pairs, {METRICS} from t""", "retention_rate bias mae rmse loa_lower loa_upper lin_ccc")
def _(spark, d):
    return E.agreement_by_category(_pairs(spark, d), ["state"], "angle", "who", "r", "c")


@query("error_slopes_by_angle", PAIRS + f""", pm as (select who, count(*) n, sum(angle) x, sum(angle * angle) xx, sum(c - r) e, sum(angle * (c - r)) xe, sum(abs(c - r)) a, sum(angle * abs(c - r)) xa from d where who is not null and angle is not null and c is not null and r is not null group by who),
 w as (select *, row_number() over (order by who) - 1 slot, count(*) over () g from pm), dr as (select round, {DRAWS.format(more="")} pick from w, range(1, 101) r(round) where g >= 2),
 b as (select round, {', '.join(f'sum(m * {c}) {c}' for c in ('n', 'x', 'xx', 'e', 'xe', 'a', 'xa'))} from (select round, pick, count(*) m from dr group by all) dr join w on w.slot = dr.pick group by round),
 f as (select (xe - x * e / n) / (xx - x * x / n) s, (xa - x * a / n) / (xx - x * x / n) u from b), t as (select sum(n) n_rows, count(*) n_clusters from pm), o as (select regr_slope(c - r, angle) s, regr_slope(abs(c - r), angle) u from d where who is not null)
 select 'signed_error' metric, o.s estimate, quantile_cont(f.s, 0.025) ci_low, quantile_cont(f.s, 0.975) ci_high, n_rows::bigint n_rows, n_clusters from f, o, t group by all
 union all select 'absolute_error', o.u, quantile_cont(f.u, 0.025), quantile_cont(f.u, 0.975), n_rows::bigint, n_clusters from f, o, t group by all""", "estimate ci_low ci_high")
def _(spark, d):
    return E.error_slopes(_pairs(spark, d), "who", "angle", "r", "c", 100)


# --- several conditions in one convolution model -------------------------------

G_AT = "({t} * {t} * exp(-({t}) / 1.5) / 6.75)"
DESIGN = f""", a as (select id, unit, x, t / 86400 u, row_number() over (partition by unit order by t, id) - 1 i from s), st as (select unit, u - lag(u) over (partition by unit order by u) g from (select distinct unit, u from a)), dt as (select unit, median(g) dt from st group by unit having median(g) > 0),
 kk as (select unit, dt, ceil((20 + 0.5 * dt) / dt)::bigint k from dt), pk as (select unit, dt, k, list_max(list_transform(range(k), lambda q: {G_AT.format(t="(q * dt)")})) peak from kk),
 ev as (select id e, unit, state, t / 86400 o, case when state = 'error' then 1.5 else 0 end f from s where state in ('click', 'error')),
 im as (select ev.unit, ev.state, e, arg_min(a.i, (abs(a.u - o), a.i)) j from ev join a on a.unit = ev.unit join pk on pk.unit = ev.unit where f <= dt group by ev.unit, ev.state, e union all select ev.unit, ev.state, e, a.i from ev join pk on pk.unit = ev.unit join a on a.unit = ev.unit and a.u between o and o + f where f > dt),
 hit as (select a.unit, a.i, im.state, sum({G_AT.format(t="((a.i - im.j) * dt)")} / peak) v from a join im on im.unit = a.unit and im.j <= a.i join pk on pk.unit = a.unit where a.i - im.j < k group by a.unit, a.i, im.state),
 z as (select a.id, a.unit, a.i, a.x, dt, coalesce(c.v, 0) c, coalesce(e.v, 0) e from a join pk on pk.unit = a.unit left join hit c on c.unit = a.unit and c.i = a.i and c.state = 'click' left join hit e on e.unit = a.unit and e.i = a.i and e.state = 'error')"""


def _design(spark, d, derivative=False):
    s = samples(spark, d).withColumn("u", F.col("t") / 86400)
    e = s.where("state in ('click', 'error')").select("unit", "state", F.col("u").alias("on"), F.when(F.col("state") == "error", 1.5).otherwise(0.0).alias("long"))
    return D.glm_design(s, e, ["unit"], "u", ["u", "id"], "on", "state", ["click", "error"], "long", derivative=derivative)


@query("glm_design_columns", DESIGN + " select id, 1.0::double as intercept, c pspm_click, e pspm_error, coalesce((c - lag(c) over w) / dt, 0) pspm_click_derivative, coalesce((e - lag(e) over w) / dt, 0) pspm_error_derivative from z window w as (partition by unit order by i)",
       "pspm_click pspm_error pspm_click_derivative pspm_error_derivative")
def _(spark, d):
    return _design(spark, d, True).select("id", "intercept", "pspm_click", "pspm_error", "pspm_click_derivative", "pspm_error_derivative")


@query("multi_condition_glm", DESIGN + """, g as (select unit, count(*) n, avg(x) y, avg(c) a, avg(e) b, regr_sxx(c, c) saa, regr_sxx(e, e) sbb, regr_sxy(c, e) sab, regr_sxy(x, c) say, regr_sxy(x, e) sby, regr_syy(x, x) tss from z group by unit),
 f as (select *, saa * sbb - sab * sab det, saa * sbb - sab * sab > 1e-9 * saa * sbb full_rank from g), h as (select *, (say * sbb - sby * sab) / det ba, (sby * saa - say * sab) / det bb from f where full_rank), j as (select *, greatest(tss - ba * say - bb * sby, 0) rss, n - 3 df from h),
 k as (select *, case when df > 0 then rss / df end v from j), o as (select unit, 'intercept' term, y - ba * a - bb * b estimate, sqrt(v * (1.0 / n + (a * a * sbb - 2 * a * b * sab + b * b * saa) / det)) std_error, n, rss, tss from k
 union all select unit, 'pspm_click', ba, sqrt(v * sbb / det), n, rss, tss from k union all select unit, 'pspm_error', bb, sqrt(v * saa / det), n, rss, tss from k)
 select g.unit, g.n, t.term, estimate, std_error, case when o.tss > 0 then 1 - rss / o.tss end r_squared from g cross join (select unnest(['intercept', 'pspm_click', 'pspm_error']) term) t left join o on o.unit = g.unit and o.term = t.term""", "estimate std_error r_squared")
def _(spark, d):
    fit = D.glm_fit(_design(spark, d), ["unit"], "x", ["intercept", "pspm_click", "pspm_error"])
    whole = lambda c: F.when(F.col("rank") == 3, F.col(c)).alias(c)
    return fit.select("unit", "n", "term", whole("estimate"), whole("std_error"), whole("r_squared"))


# --- detrending, artifact intervals, streams -------------------------------------

DETREND = """, a as (select unit, id, x rri_ms, t / 3600 u, count(*) over (partition by unit) n from s where x > 0), b as (select *, {trend} trend_ms from a window w as (partition by unit order by u range between 60 preceding and 60 following)),
 c as (select *, case when n >= 3 then trend_ms end tr from b) select id, rri_ms, tr trend_ms, rri_ms - tr + avg(tr) over (partition by unit) rri_detrended_ms from c"""
TRENDS = {"median": "quantile_cont(rri_ms, 0.5) over w", "mean": "avg(rri_ms) over w", "linear": "case when count(*) over w >= 3 then coalesce(regr_slope(rri_ms, u) over w * u + regr_intercept(rri_ms, u) over w, avg(rri_ms) over w) else avg(rri_ms) over w end"}

for _m, _e in TRENDS.items():
    query(f"rri_detrend_{_m}", DETREND.format(trend=_e), "rri_ms trend_ms rri_detrended_ms")(
        lambda spark, d, m=_m: C.detrend_intervals(samples(spark, d).withColumn("u", F.col("t") / 3600), ["unit"], "x", ["u", "id"], "u", 120.0, m).select("id", "rri_ms", "trend_ms", "rri_detrended_ms"))

SCR = """, a as (select id, state g, t, xm scr_raw, row_number() over w - 1 i, count(*) over (partition by state) n, xm - lag(xm) over w dx, t - lag(t) over w dt from (select * replace (case when xm is not null then round(xm / 2) * 2 end as xm) from s) window w as (partition by state order by t, id)),
 b as (select *, scr_raw is null or scr_raw < 60 or scr_raw > 150 rg, coalesce(abs(dx) / nullif(dt, 0) > 0.02, false) sl, coalesce(abs(dx) <= 3, false) fl from a),
 c as (select *, count(*) over (partition by g, fl, k) len from (select *, i - row_number() over (partition by g, fl order by i) k from b)), e as (select *, fl and len >= 3 cl, rg or sl or (fl and len >= 3) bad from c),
 f as (select *, not bad and count(*) over (partition by g, bad, k2) < 4 isl from (select *, i - row_number() over (partition by g, bad order by i) k2 from e)),
 h as (select *, coalesce(max((bad or isl)::int) over (partition by g order by i rows between 2 preceding and 2 following) = 1, false) art from f),
 j as (select *, case when not art then scr_raw end v, last_value(case when not art then i end ignore nulls) over (partition by g order by i) pa, first_value(case when not art then i end ignore nulls) over (partition by g order by i rows between current row and unbounded following) pb from h),
 l as (select j.*, p.scr_raw va, q.scr_raw vb from j left join j p on p.g = j.g and p.i = j.pa left join j q on q.g = j.g and q.i = j.pb),
 m as (select *, coalesce(v, va + (vb - va) * (i - pa) / (pb - pa)::double, va, vb) scr_clean from l),
 o as (select *, case when count(scr_clean) over w = 5 then avg(scr_clean) over w else scr_clean end scr_processed from m window w as (partition by g order by i rows between 2 preceding and 2 following))
 select id, scr_raw, art artifact, case when rg or sl or cl or isl then concat_ws(';', case when rg then 'range_or_nonfinite' end, case when sl then 'slope' end, case when cl then 'clipping' end, case when isl then 'short_valid_island' end) when art then 'artifact_epoch' else 'accepted' end artifact_reason, scr_clean, scr_processed from o"""


@query("scr_artifact_cleaning", SCR, "scr_raw scr_clean scr_processed")
def _(spark, d):
    s = samples(spark, d).withColumn("v", F.round(F.col("xm") / 2) * 2)
    out = C.clean_conductance(s, ["state"], "v", "t", ORDER, 1.0, (60.0, 150.0), 0.02, 3.0, 3.0, 4.0, 2.0, 5.0)
    return out.select("id", "scr_raw", "artifact", "artifact_reason", "scr_clean", "scr_processed")


STREAMS = """, r as (select id, unit, t, x, t - min(t) over (partition by unit) rel from s where state = 'view'), z as (select unit, min(t) z from s where state = 'view' group by unit),
 b as (select s.unit, s.id, xm v, t + 5 - 2 - z rel from s left join z using (unit) where state = 'click'), c as (select s.unit, s.id, h v, t - z rel from s left join z using (unit) where state = 'error'),
 nb as (select r.id, arg_min_null(b.v, (abs(b.rel - r.rel), b.rel, b.id)) nv, arg_min(b.rel, (abs(b.rel - r.rel), b.rel, b.id)) - any_value(r.rel) gap from r join b on b.unit = r.unit group by r.id), nc as (select r.id, arg_min_null(c.v, (abs(c.rel - r.rel), c.rel, c.id)) nv, arg_min(c.rel, (abs(c.rel - r.rel), c.rel, c.id)) - any_value(r.rel) gap from r join c on c.unit = r.unit group by r.id)
 select r.id, r.rel relative_s, {cells} from r left join nb on nb.id = r.id left join nc on nc.id = r.id"""


def _streams(spark, d):
    s = samples(spark, d)
    return {"view": M.Stream(s.where("state = 'view'"), "t", ["id", "x"], ["t", "id"]), "click": M.Stream(s.where("state = 'click'"), "t", ["xm"], ["t", "id"], 5.0, 2.0), "error": M.Stream(s.where("state = 'error'"), "t", ["h"], ["t", "id"])}


@query("streams_nearest_merge", STREAMS.format(cells="nb.nv click__xm, nc.nv error__h, nb.gap click__time_difference_s, nc.gap error__time_difference_s"), "relative_s click__xm click__time_difference_s error__time_difference_s")
def _(spark, d):
    out = M.merge_nearest(_streams(spark, d), ["unit"], "view")
    return out.select("id", "relative_s", "click__xm", "error__h", "click__time_difference_s", "error__time_difference_s")


@query("streams_tolerant_merge", STREAMS.format(cells="case when abs(nb.gap) <= 86400 then nb.nv end click__xm, case when abs(nc.gap) <= 86400 then nc.nv end error__h, case when abs(nb.gap) <= 86400 then nb.gap end click__time_difference_s, case when abs(nc.gap) <= 86400 then nc.gap end error__time_difference_s"),
       "relative_s click__xm click__time_difference_s error__time_difference_s")
def _(spark, d):
    out = M.merge_nearest(_streams(spark, d), ["unit"], "view", 86400.0)
    return out.select("id", "relative_s", "click__xm", "error__h", "click__time_difference_s", "error__time_difference_s")


@query("streams_audit", """select state as stream, count(*) n_samples, case when state = 'click' then 5.0 else 0.0 end::double clock_offset_s, case when state = 'click' then 2.0 else 0.0 end::double known_lag_s from s where state in ('view', 'click', 'error') group by state""")
def _(spark, d):
    return M.stream_audit(_streams(spark, d))


# --- folders of exports ------------------------------------------------------------


@query("export_folder_profile", """with e as (select 'events' kind, unnest([{'c': 'event_id', 'v': event_id::varchar, 'role': 'ttl_event'}, {'c': 'USER', 'v': user_id::varchar, 'role': 'ttl_event'}, {'c': 'GSR', 'v': case when value >= 60 then value::varchar end, 'role': 'eda_gsr'}, {'c': 'label', 'v': event_type, 'role': 'other'}]) r from events
 union all select 'people', unnest([{'c': 'account', 'v': c_custkey::varchar, 'role': 'other'}, {'c': 'HEART_RATE', 'v': c_acctbal::varchar, 'role': 'heart_rate'}, {'c': 'TIME', 'v': '0', 'role': 'time'}]) from customer),
 f as (select kind, r.c as "column", r.role as "role", r.v v, try_cast(r.v as double) x from e)
 select kind, "column", "role", case when count(x) = count(v) then 'numeric' else 'character' end "type", count(*) n_rows, count(*) - count(v) n_missing, case when count(x) = count(v) then count(distinct x) else count(distinct v) end n_unique, case when count(x) = count(v) then stddev_samp(x) end numeric_sd,
 coalesce(count(x) = count(v) and min(x) = 0 and max(x) = 0, false) all_zero, count(distinct v) <= 1 "constant" from f group by all""", "numeric_sd")
def _(spark, d):
    # the tables are written as exports of two kinds, under separators of their own, into a new folder beside the checkpoints
    kept(spark.range(1))
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/") + f"/exports-{uuid.uuid4().hex}"
    e, c = spark.read.parquet(f"{d}/events.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    e = e.select("event_id", F.col("user_id").alias("USER"), F.when(F.col("value") >= 60, F.col("value")).alias("GSR"), F.col("event_type").alias("label"))
    e.coalesce(1).write.csv(f"{root}/kind=events", header=True, sep=";", nullValue="NA")
    c.select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("HEART_RATE"), F.lit(0).alias("TIME")).coalesce(1).write.csv(f"{root}/kind=people", header=True)
    columns = X.profile_folder(spark, root, recursive=True)["columns"]
    return columns.select(F.regexp_extract("file", "kind=([^/]*)", 1).alias("kind"), "column", "role", "type", "n_rows", "n_missing", "n_unique", "numeric_sd", "all_zero", "constant")
