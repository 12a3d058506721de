"""Registered queries of peaks, responses, beats and beat shapes, and the same in SQL: greedy choices are recursions over the peaks in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beats as B, cardiac as C
from .queries import ORDER, query, samples

SAMPLES = """with recursive p as (select user_id unit, epoch_us(ts) / 1e6 t, value::double v, row_number() over (partition by user_id order by ts, event_id) - 1 rn, count(*) over (partition by user_id) n from events where value is not null),
 b as (select *, lag(v) over (partition by unit order by rn) l, lead(v) over (partition by unit order by rn) r from p)"""


def _thinned(where: str, distance: int) -> str:
    return f""", c as (select unit, rn, v, row_number() over (partition by unit order by v desc, rn) k from b where v > l and v >= r{where}),
 g(unit, k, kept) as (select distinct unit, 0::bigint, []::bigint[] from c union all
 select c.unit, c.k, case when len(list_filter(g.kept, lambda q: abs(q - c.rn) < {distance})) = 0 then list_append(g.kept, c.rn) else g.kept end from g join c on c.unit = g.unit and c.k = g.k + 1),
 f as (select unit, unnest(arg_max(kept, k)) rn from g group by unit)"""


def _responses(where: str, distance: int, least: float, falls: str) -> str:
    return SAMPLES + _thinned(where, distance) + f""", o as (select f.unit, f.rn, p.t, p.v, (select max(b.rn) from b where b.unit = f.unit and b.rn <= f.rn and (b.l is null or {falls})) foot from f join p using (unit, rn)),
 a as (select o.*, q.t onset, o.v - q.v amplitude from o join p q on q.unit = o.unit and q.rn = o.foot), d as (select a.*, (select min(q.rn) from p q where q.unit = a.unit and q.rn > a.rn and q.v <= a.v - 0.5 * amplitude) back from a where amplitude >= {least})
 select d.unit, onset, d.t as peak, amplitude, d.t - onset rise_time, q.t - d.t recovery, case when back is null then 'detected_incomplete_recovery' else 'detected' end status from d left join p q on q.unit = d.unit and q.rn = d.back"""


RESPONSE = "onset peak amplitude rise_time recovery"


@query("scr_peaks_by_height", _responses(" and v >= 50", 3, 10.0, "b.v <= b.l"), RESPONSE)
def _(spark, d):
    return B.scr_peaks(samples(spark, d), ["unit"], "x", "t", ORDER, 50.0, 3, 10.0)


@query("scr_responses", _responses("", 5, 20.0, "b.v < b.l"), RESPONSE)
def _(spark, d):
    return B.scr_peaks(samples(spark, d), ["unit"], "x", "t", ORDER, None, 5, 20.0, flat_rises=True)


# Rate 4, intervals of 180 a minute at most: 1 sample apart; the average spans 7 samples. Times are days here, so every rate is allowed.
BEATS = SAMPLES + """, u as (select unit, avg(v) m, coalesce(nullif(stddev_samp(v), 0), 1) sd, (max(t) - min(t)) / 60 as dur from p group by unit),
 w as (select p.*, count(*) over y c, avg(v) over y a from p window y as (partition by unit order by rn rows between 3 preceding and 3 following)),
 e as (select w.unit, w.rn, w.t, w.v, o from w join u using (unit), (select unnest(range(-5, 26)) / 20.0::double o) where round((v - case when c = 7 then a else m end) / sd, 9) > o),
 h as (select *, rn - row_number() over (partition by unit, o order by rn) z from e), i as (select unit, o, arg_max(rn, (v, -rn)) rn, arg_max(t, (v, -rn)) t, max(v) v from h group by unit, o, z),
 j as (select *, row_number() over (partition by unit, o order by rn) k from i),
 s(unit, o, k, past, rn, t, v) as (select unit, o, k, []::struct(rn bigint, t double, v double)[], rn, t, v from j where k = 1 union all
 select j.unit, j.o, j.k, case when j.rn - s.rn >= {least} then list_append(past, struct_pack(rn := s.rn, t := s.t, v := s.v)) else past end,
 case when j.rn - s.rn >= {least} or j.v > s.v then j.rn else s.rn end, case when j.rn - s.rn >= {least} or j.v > s.v then j.t else s.t end, case when j.rn - s.rn >= {least} or j.v > s.v then j.v else s.v end
 from s join j on j.unit = s.unit and j.o = s.o and j.k = s.k + 1),
 last as (select unit, o, unnest(list_append(arg_max(past, k), struct_pack(rn := arg_max(rn, k), t := arg_max(t, k), v := arg_max(v, k))), recursive := true) from s group by unit, o),
 x as (select *, t - lag(t) over (partition by unit, o order by rn) iv from last), dd as (select *, iv - lag(iv) over (partition by unit, o order by rn) ch from x),
 fit as (select unit, o, count(*) n, case when count(ch) >= 2 then stddev_samp(ch order by rn) end sp from dd group by unit, o),
 best as (select unit, arg_min(o, (case when sp > 0 then sp else 'inf'::double end, o)) o from fit join u using (unit) where n >= 3 and dur > 0 group by unit),
 beat as (select x.unit, x.t as beat_time, x.v as beat_value, iv as "interval", x.o as "offset" from x left join best using (unit) where x.o = coalesce(best.o, 0))"""
EVERY = (0.0, 180.0)


def _beats(spark, d, rate):
    return B.beats(samples(spark, d), ["unit"], "x", "t", ORDER, rate, EVERY, average=3.0 / rate)


@query("pulse_beats", BEATS.format(least=1) + " select * from beat", 'beat_time beat_value "interval" "offset"')
def _(spark, d):
    return _beats(spark, d, 3.0)


REJECTED = BEATS.format(least=3) + """, y as (select *, case when count(*) over (partition by unit) >= 3 then (beat_time - lag(beat_time) over (partition by unit order by beat_time)) * 1000 end rr_ms from beat),
 z as (select *, coalesce(rr_ms between a - greatest(0.3 * a, 3e8) and a + greatest(0.3 * a, 3e8), true) accepted from (select *, avg(rr_ms) over (partition by unit) a from y))"""


def _rejected(spark, d):
    return B.rejected(_beats(spark, d, 12.0), ["unit"], least_ms=3e8)


@query("pulse_beats_rejected", REJECTED + " select unit, beat_time, rr_ms, accepted from z", "beat_time rr_ms")
def _(spark, d):
    return _rejected(spark, d).select("unit", "beat_time", "rr_ms", "accepted")


@query("pulse_measures", REJECTED + """, q as (select unit, beat_time t, (beat_time - lag(beat_time) over (partition by unit order by beat_time)) * 1000 rr from z where accepted), e2 as (select *, rr - lag(rr) over (partition by unit order by t) d2 from q),
 y2 as (select unit, count(*) n_peaks, 60 * count(*) / nullif(max(t) - min(t), 0) bpm, avg(rr) ibi_ms, stddev_samp(rr) sdnn_ms, stddev_samp(d2) sdsd_ms, sqrt(avg(d2 * d2)) rmssd_ms, avg((abs(d2) > 20)::int) pnn20, avg((abs(d2) > 50)::int) pnn50, 1.4826 * mad(rr) mad_rr_ms from e2 group by unit)
 select b.unit, coalesce(n_peaks, 0) n_peaks, case when n_peaks >= 3 then bpm end bpm, case when n_peaks >= 3 then ibi_ms end ibi_ms, case when n_peaks >= 3 then sdnn_ms end sdnn_ms, case when n_peaks >= 3 then sdsd_ms end sdsd_ms,
 case when n_peaks >= 3 then rmssd_ms end rmssd_ms, case when n_peaks >= 3 then pnn20 end pnn20, case when n_peaks >= 3 then pnn50 end pnn50, case when n_peaks >= 3 then mad_rr_ms end mad_rr_ms from (select distinct unit from beat) b left join y2 using (unit)""",
       "bpm ibi_ms sdnn_ms sdsd_ms rmssd_ms pnn20 pnn50 mad_rr_ms")
def _(spark, d):
    return B.measures(_rejected(spark, d), ["unit"])


@query("pulse_template_similarity", SAMPLES + _thinned("", 3) + """, o as (select f.unit, f.rn beat, k from f join p using (unit, rn), (select unnest(range(-2, 3)) k) where f.rn >= 2 and f.rn < p.n - 2), v as (select o.*, p.v from o join p on p.unit = o.unit and p.rn = o.beat + o.k),
 m as (select unit, k, median(v) m from v group by unit, k), r as (select unit, beat, case when var_pop(v) > 0 and var_pop(m) > 0 then corr(v, m) else 0 end r from v join m using (unit, k) group by unit, beat), a as (select unit, count(*) n, avg(r) mean_r, min(r) min_r from r group by unit)
 select e.unit, coalesce(n, 0) beats, case when n >= 2 then mean_r end mean_r, case when n >= 2 then min_r end min_r from (select distinct user_id unit from events) e left join a using (unit)""", "mean_r min_r")
def _(spark, d):
    return B.template_similarity(samples(spark, d), ["unit"], "x", ORDER, 3, 2)


_BANDS = list(C.BANDS)
_COLUMNS = ["total_power", *[f"{b}_abs" for b in _BANDS], *[f"{b}_rel" for b in _BANDS], "lf_norm", "hf_norm", "lf_hf", *[f"{b}_peak" for b in _BANDS]]
WELCH = f"""with d as (select user_id unit, value + 600 x, row_number() over y rn, sum(value + 600) over y ms, count(*) over (partition by user_id) n from events where value + 600 between 250 and 2500 window y as (partition by user_id order by ts, event_id)),
 a as (select unit, rn, x, round((ms - first_value(x) over (partition by unit order by rn)) / 1000, 9) a from d where n >= 4), b as (select *, lead(a) over (partition by unit order by rn) b, lead(x) over (partition by unit order by rn) z from a),
 g as (select unit, j, case when b is null then x else x + (z - x) * (j / 4.0::double - a) / (b - a) end y from b, lateral (select unnest(range(ceil(a * 4 - 1e-9)::bigint, coalesce(ceil(b * 4 - 1e-9), floor(a * 4 + 1e-9) + 1)::bigint)) j)),
 m as (select unit, max(j) + 1 n, avg(y) y0, least(max(j) + 1, 64) w from g group by unit having max(j) + 1 >= 8), s as (select g.unit, k, w, j - k * step i, y - y0 y from (select *, greatest(1, round_even(w * 0.5, 0))::bigint step from m) m join g using (unit), lateral (select unnest(range(0, (n - w) // step + 1)) k) where j between k * step and k * step + w - 1),
 f as (select unit, w, k, h, sum(t * cos(2 * pi() * h * i / w)) ** 2 + sum(t * sin(2 * pi() * h * i / w)) ** 2 q from (select *, y * (0.5 - 0.5 * cos(2 * pi() * i / (w - 1))) t from s), lateral (select unnest(range(1, w // 2)) h) group by all),
 p as (select unit, h * 4.0::double / w f, avg(q) / (w * 4.0::double) v from f group by unit, w, h having h * 4.0 / w < 0.4 union all select unit, 0::double, 0::double from m),
 r as (select unit, f, v, case when f < 0.003 then 'ulf' when f < 0.04 then 'vlf' when f < 0.15 then 'lf' else 'hf' end band from p), e as (select *, (f - lag(f) over o) * (v + lag(v) over o) / 2 u from r window o as (partition by unit, band order by f)),
 c as (select unit, coalesce(sum(u), 0) total_power, {", ".join(f"sum(u) filter (band = '{b}') {b}_abs" for b in _BANDS)}, {", ".join(f"arg_max(f, (v, -f)) filter (band = '{b}') {b}_peak" for b in _BANDS)} from e group by unit)
 select q.unit, coalesce(total_power, 0) total_power, {", ".join(f"{b}_abs" for b in _BANDS)}, {", ".join(f"100 * {b}_abs / nullif(total_power, 0) {b}_rel" for b in _BANDS)}, 100 * lf_abs / nullif(lf_abs + hf_abs, 0) lf_norm, 100 * hf_abs / nullif(lf_abs + hf_abs, 0) hf_norm,
 lf_abs / nullif(hf_abs, 0) lf_hf, {", ".join(f"{b}_peak" for b in _BANDS)} from (select distinct user_id unit from events) q left join c using (unit)"""


@query("hrv_frequency_domain", WELCH, " ".join(_COLUMNS))
def _(spark, d):
    return C.frequency_domain(samples(spark, d).withColumn("x", F.col("x") + 600), ["unit"], "x", ORDER, 4.0, 16.0)
