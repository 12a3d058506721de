"""Registered queries over the given tables, and the same in SQL.

``samples`` reads the event table as a sensor recording: unit = user, t =
seconds, x = value, state = event type, xm = the value with gaps (below 60 is
missing). Each SQL text is written on its own terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.core import rounded
from ..sources import exports as X, sinks as K
from . import provenance as P
from ..operators import cardiac as C, complexity as Y, events as E, joins as J, quality as Q, scans as R, standardize as S, stats as T, summaries as M, waveforms as V, windows as W

QUERIES, SQL = {}, {}
ORDER = ["t", "id"]
CTE = "with s as (select event_id id, user_id unit, epoch_us(ts) / 1e6 t, value x, event_type state, case when value >= 60 then value end xm, hour(ts) h from events)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("unit"), t.alias("t"), F.col("value").alias("x"), F.col("event_type").alias("state"),
                    F.when(F.col("value") >= 60, F.col("value")).alias("xm"), F.hour(F.col("ts")).alias("h"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def halves(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds to nine digits ahead of the six of every query, so that a value halfway between two results goes up in whatever order its sum was made."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def by_product(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds to six digits as the SQL does, by the product with a million: its own last bit moves some values halfway between two results."""
    return df.withColumns({c: F.when(F.abs(c) < 1e300, F.round(F.col(c) * 1e6) / 1e6).otherwise(F.col(c)) for c in columns})


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Registers a query; ``doubles`` names the columns that the SQL rounds as the query does."""

    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            body = sql if sql.lstrip().lower().startswith("with") else f"{CTE} {sql}"
            fix = ", ".join(f"round({c}, 6)::double as {c}" for c in doubles.split())
            SQL[name] = f"select * replace ({fix}) from ({body}) q" if fix else body
        return f

    return put


# --- windows and grouped aggregation ---------------------------------------

WINDOW_SQL = """select {k}, count(*) n_rows, count(v) usable_rows, avg(v) mean, median(v) median, stddev_samp(v) sd, min(v) min, max(v) max,
 arg_min(v, (t, id)) as first, arg_max(v, (t, id)) as last, 100.0 * count(v) / count(*) usable_pct, arg_max(v, (t, id)) - arg_min(v, (t, id)) as change
 from (select *, case when {ok} then {x} end v from s) group by {k}"""
WINDOW_DOUBLES = "mean median sd min max first last usable_pct change"


@query("windows_signal_summary", WINDOW_SQL.format(k="state", x="x", ok="x is not null and x <> 0"), WINDOW_DOUBLES)
def _(spark, d):
    return W.signal_windows(samples(spark, d), ["state"], "x", ORDER)


@query("windows_keep_zero_by_unit", WINDOW_SQL.format(k="unit", x="xm", ok="xm is not null"), WINDOW_DOUBLES)
def _(spark, d):
    return W.signal_windows(samples(spark, d), ["unit"], "xm", ORDER, keep_zero=True)


@query("windows_multimodal", """select unit, count(*) n_rows, count(case when x <> 0 then 1 end) a_usable, avg(case when x <> 0 then x end) a_mean, stddev_samp(case when x <> 0 then x end) a_sd, arg_max(x, (t, id)) a_last,
 count(xm) b_usable, avg(xm) b_mean, stddev_samp(xm) b_sd, arg_max(xm, (t, id)) filter (xm is not null) b_last from s group by unit""", "a_mean a_sd a_last b_mean b_sd b_last")
def _(spark, d):
    w = W.multimodal_windows(samples(spark, d), ["unit"], {"a": "x", "b": "xm"}, [F.isnull("t"), *ORDER], "id", last_zero=True)
    return by_product(w, "a_mean", "a_sd", "a_last", "b_mean", "b_sd", "b_last")


@query("aoi_signal_rollup", """select unit, state, (grouping(unit) * 2 + grouping(state))::bigint as level, count(xm) n, avg(xm) mean, stddev_samp(xm) sd, min(xm) min, max(xm) max
 from s group by grouping sets ((unit, state), (state), (unit), ())""", "mean sd min max")
def _(spark, d):
    return W.aoi_summary(samples(spark, d), "unit", "state", "xm")


@query("aoi_timecourse", """, b as (select floor(t / 86400)::bigint bin, state from s), c as (select bin, count(*) total from b group by bin)
 select c.bin, a.state, count(b.bin) n, count(b.bin) / any_value(total)::double share from c cross join (select distinct state from s) a left join b on b.bin = c.bin and b.state = a.state group by all""", "share")
def _(spark, d):
    return W.aoi_timecourse(samples(spark, d), "t", "state", 86400.0)


@query("aoi_dwell", """, g as (select *, least(coalesce(lead(t) over w - t, 0), 86400.0) gap, coalesce(state <> lag(state) over w, true) entry, min(t) over (partition by unit) t0 from s window w as (partition by unit order by t, id))
 select unit, state, sum(gap) dwell, count(*) filter (entry) entries, min(t) - min(t0) latency, count(*) n from g group by unit, state""", "dwell latency")
def _(spark, d):
    return W.aoi_dwell(samples(spark, d), "unit", "state", "t", ORDER, 86400.0)


@query("scanpath_metrics", """, g as (select *, x - lag(x) over w dx, h - lag(h) over w dy, lag(state) over w was from s window w as (partition by unit order by t, id)),
 e as (select unit, entropy(was || '>' || state) entropy from g where was <> state group by unit)
 select unit, sum(sqrt(dx * dx + dy * dy)) path, count(*) filter (sqrt(dx * dx + dy * dy) > 50) long_steps, count(*) filter (dx < 0) regressions, count(*) filter (was <> state) transitions, coalesce(any_value(e.entropy), 0) entropy
 from g left join e using (unit) group by unit""", "path entropy")
def _(spark, d):
    return W.scanpath(samples(spark, d).withColumn("h", F.col("h").cast("double")), "unit", "state", "x", "h", ORDER, 50.0)


@query("missing_runs", """, g as (select *, row_number() over (partition by unit order by t, id) - row_number() over (partition by unit, xm is null order by t, id) k from s),
 r as (select unit, xm is null m, count(*) n, max(t) - min(t) span from g group by unit, xm is null, k)
 select unit, sum(n)::bigint n_rows, coalesce(sum(n) filter (m), 0)::bigint n_missing, count(*) filter (m) runs, coalesce(max(n) filter (m), 0)::bigint longest_run, coalesce(max(span) filter (m), 0) longest_gap, count(*) filter (m and span > 86400) long_gaps from r group by unit""", "longest_gap")
def _(spark, d):
    return W.missing_runs(samples(spark, d), ["unit"], "xm", "t", ORDER, 86400.0)


@query("signal_quality", """, g as (select *, xm = lag(xm) over (partition by unit order by t, id) flat, median(xm) over (partition by unit) c from s), m as (select unit, mad(xm) mad from s group by unit)
 select unit, count(*) n_rows, count(*) filter (xm is null) / count(*)::double missing, median(xm) median, any_value(m.mad) mad, quantile_cont(xm, 0.75) - quantile_cont(xm, 0.25) iqr, count(*) filter (flat) / count(*)::double flat,
 count(*) filter (m.mad > 0 and 0.6744897501960817 * abs(xm - c) / m.mad > 3.5) extremes from g join m using (unit) group by unit""", "missing median mad iqr flat")
def _(spark, d):
    return W.signal_quality(samples(spark, d), ["unit"], "xm", ORDER)


@query("engagement_index", """, g as (select *, lead(t) over w - t dt, lead(xm) over w nx from s where xm is not null window w as (partition by unit order by t, id))
 select unit, max(t) - min(t) duration, avg(xm) mean, coalesce(coalesce(sum(dt) filter (xm > 100), null) / nullif(sum(dt), 0), 0) above, stddev_samp(nx - xm) volatility, sum((xm + nx) / 2 * dt) area from g group by unit""", "duration mean above volatility area")
def _(spark, d):
    return W.engagement_index(samples(spark, d), ["unit"], "xm", "t", ORDER, 100.0)


@query("downsample_tumbling", """select unit, floor(t / 604800) * 604800 bin_start, count(xm) n, avg(xm) mean, median(xm) median, arg_min(xm, (t, id)) filter (xm is not null) as first, arg_max(xm, (t, id)) filter (xm is not null) as last from s group by unit, floor(t / 604800) * 604800""", "bin_start mean median first last")
def _(spark, d):
    return W.downsample(samples(spark, d), ["unit"], "xm", "t", ORDER, 604800.0)


@query("upsample_linear", """, a as (select unit, t, avg(x) x from s group by unit, t), e as (select unit, ceil(min(t) / 43200)::bigint lo, floor(max(t) / 43200)::bigint hi from a group by unit),
 g as (select unit, unnest(range(lo, hi + 1)) * 43200.0::double t from e), p as (select g.unit, g.t, a.t t1, a.x x1 from g asof join a on g.unit = a.unit and g.t >= a.t),
 n as (select p.*, a.t t2, a.x x2 from p asof join a on p.unit = a.unit and p.t <= a.t)
 select unit, t, case when t2 = t1 then x1 else x1 + (t - t1) / (t2 - t1) * (x2 - x1) end x from n""", "t x")
def _(spark, d):
    return W.upsample(samples(spark, d), ["unit"], "x", "t", 43200.0)


@query("timecourse_grid_audit", """with o as (select o_custkey % 200 subject, o_orderpriority c, month(o_orderdate) m from orders), w as (select * from (select distinct subject from o) cross join (select distinct c from o) cross join (select distinct m from o)),
 k as (select w.subject, w.c, w.m, count(o.subject) n from w left join o using (subject, c, m) group by all) select subject, count(*) cells, count(*) filter (n = 0) missing, count(*) filter (n > 1) repeated from k group by subject""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("subject", F.col("o_custkey") % 200)
    return W.timecourse_grid(o, "subject", "o_orderpriority", F.month("o_orderdate"))


@query("validity_summary", """select state, count(*) n_rows, count(xm) n_finite, count(distinct xm) n_unique, case when count(xm) = 0 then 'missing' when count(distinct xm) = 1 then 'constant' when max(abs(xm)) = 0 then 'zero' else 'active' end status from s group by state""")
def _(spark, d):
    return W.validity_summary(samples(spark, d), ["state"], "xm")


@query("exclusion_recommendations", """, w as (select unit, state, 100.0 * count(xm) / count(*) p, stddev_samp(xm) sd from s group by unit, state), y as (select unit, case when p < 40 or sd is null then 'exclude' when p < 60 then 'review' else 'keep' end say from w)
 select unit, count(*) n_windows, count(*) filter (say = 'keep') n_keep, count(*) filter (say = 'review') n_review, count(*) filter (say = 'exclude') n_exclude from y group by unit""")
def _(spark, d):
    w = samples(spark, d).groupBy("unit", "state").agg((100 * F.count("xm") / F.count("*")).alias("p"), F.stddev_samp("xm").alias("sd"))
    return W.recommend_exclusions(w, "unit", "p", "sd", 40, 60)


@query("quality_index", """, m as (select unit, avg(x) a, count(*)::double n from s group by unit), e as (select min(a) la, max(a) ha, min(n) ln, max(n) hn from m)
 select unit, a, n, (a - la) / (ha - la) * (2.0 / 3) + (n - ln) / (hn - ln) * (1.0 / 3) as index from m, e""", "a n index")
def _(spark, d):
    m = samples(spark, d).groupBy("unit").agg(F.avg("x").alias("a"), F.count("*").cast("double").alias("n"))
    return W.quality_index(m, {"a": 2.0, "n": 1.0})


# --- standardisation, imputation, sessions ----------------------------------


@query("zscore_within_unit", """, g as (select id, xm, count(xm) over w n, avg(xm) over w m, stddev_samp(xm) over w sd from s window w as (partition by unit))
 select id, case when n < 3 then 'too_few' when coalesce(sd, 0) = 0 then 'zero_sd' else 'ok' end z_status, case when n >= 3 and sd > 0 then (xm - m) / sd end z from g""", "z")
def _(spark, d):
    return S.zscore(samples(spark, d), ["unit"], "xm").select("id", "z_status", "z")


@query("range_correction", """select id, case when max(xm) over w > min(xm) over w then (xm - min(xm) over w) / (max(xm) over w - min(xm) over w) else 0.0 end ranged from s window w as (partition by unit)""", "ranged")
def _(spark, d):
    return S.range_correction(samples(spark, d), ["unit"], "xm", 0.0).select("id", "ranged")


@query("within_unit_reference", """, r as (select unit, avg(x) m, stddev_samp(x) sd from s where state = 'view' group by unit) select id, case when sd > 0 then (x - m) / sd end scaled from s left join r using (unit)""", "scaled")
def _(spark, d):
    return S.within_unit(samples(spark, d), ["unit"], "x", F.col("state") == "view").select("id", "scaled")


for _m, _e in {"z": "(x - avg(x) over w) / stddev_samp(x) over w", "percent_max": "case when max(x) over w > 0 then 100 * x / max(x) over w end", "range": "(x - min(x) over w) / nullif(max(x) over w - min(x) over w, 0)", "center": "x - avg(x) over w",
               "log_z": "(ln(1 + greatest(x, 0)) - avg(ln(1 + greatest(x, 0))) over w) / nullif(stddev_samp(ln(1 + greatest(x, 0))) over w, 0)"}.items():
    query(f"normalize_{_m}", f"select id, coalesce({_e}, 0) normalized from s window w as (partition by unit)", "normalized")(
        lambda spark, d, m=_m: S.normalize(samples(spark, d), ["unit"], "x", m).select("id", "normalized"))


@query("baseline_correct_mean", """, b as (select unit, avg(x) b from s where state = 'view' and x <> 0 group by unit) select id, b baseline, x - b corrected from s left join b using (unit)""", "baseline corrected")
def _(spark, d):
    return S.baseline_correct(samples(spark, d), ["unit"], "x", F.col("state") == "view").select("id", "baseline", "corrected")


@query("baseline_correct_median", """, b as (select unit, median(x) b from s where state = 'view' and x <> 0 group by unit) select id, b baseline, x - b corrected from s left join b using (unit)""", "baseline corrected")
def _(spark, d):
    return S.baseline_correct(samples(spark, d), ["unit"], "x", F.col("state") == "view", "median").select("id", "baseline", "corrected")


@query("smooth_centred_mean", "select id, avg(xm) over (partition by unit order by t, id rows between 2 preceding and 2 following) smooth from s", "smooth")
def _(spark, d):
    return S.smooth(samples(spark, d), ["unit"], "xm", ORDER, 5).select("id", "smooth")


@query("smooth_rolling_median", "select id, quantile_cont(x, 0.5) over (partition by unit order by t, id rows between 2 preceding and 2 following) smooth from s", "smooth")
def _(spark, d):
    return S.smooth(samples(spark, d), ["unit"], "x", ORDER, 5, "median").select("id", "smooth")


@query("detrend_linear", ", f as (select unit, regr_slope(x, (t - 1.7e9) / 1e6) b, regr_intercept(x, (t - 1.7e9) / 1e6) a, avg(x) m from s group by unit) select id, x - coalesce(a + b * (t - 1.7e9) / 1e6, m) detrended from s join f using (unit)", "detrended")
def _(spark, d):
    return S.detrend(samples(spark, d).withColumn("t6", (F.col("t") - 1.7e9) / 1e6), ["unit"], "x", "t6").select("id", "detrended")


@query("tonic_phasic", """, a as (select *, quantile_cont(x, 0.5) over (partition by unit order by t, id rows between 3 preceding and 3 following) tonic from s), b as (select *, x - tonic phasic from a), m as (select unit, median(phasic) c, 1.4826 * mad(phasic) threshold from b group by unit)
 select id, tonic, phasic, threshold, coalesce(phasic > lag(phasic) over w, true) and coalesce(phasic >= lead(phasic) over w, true) and phasic - c > 3 * threshold peak from b join m using (unit) window w as (partition by unit order by t, id)""", "tonic phasic threshold")
def _(spark, d):
    return S.tonic_phasic(samples(spark, d), ["unit"], "x", ORDER, 7).select("id", "tonic", "phasic", "threshold", "peak")


def _impute_sql(fill: str) -> str:
    return f""", a as (select *, max(case when xm is not null then rn end) over (partition by unit order by rn) pr, min(case when xm is not null then rn end) over (partition by unit order by rn rows between current row and unbounded following) nr
 from (select *, row_number() over (partition by unit order by t, id) rn from s)), j as (select a.*, p.t t1, p.xm x1, n.t t2, n.xm x2, count(*) over (partition by a.unit, a.pr, a.nr) size from a left join a p on p.unit = a.unit and p.rn = a.pr left join a n on n.unit = a.unit and n.rn = a.nr)
 select id, case when xm is not null then xm when size <= 3 then {fill} end imputed, xm is null and size <= 3 and ({fill}) is not null was_imputed from j"""


for _m, _e in {"linear": "x1 + coalesce((t - t1) / nullif(t2 - t1, 0), 0) * (x2 - x1)", "locf": "x1", "nocb": "x2", "nearest": "case when t1 is null then x2 when t2 is null then x1 when t - t1 <= t2 - t then x1 else x2 end"}.items():
    query(f"impute_{_m}", _impute_sql(_e), "imputed")(lambda spark, d, m=_m: S.impute(samples(spark, d), ["unit"], "xm", "t", ORDER, m, 3).select("id", "imputed", "was_imputed"))


@query("adaptive_ema", """with recursive s as (select event_id id, user_id unit, case when value >= 60 then value end x, row_number() over (partition by user_id order by ts, event_id) rn from events), q as (select unit, quantile_cont(x, 0.25) a, quantile_cont(x, 0.75) b from s group by unit),
 v as (select s.*, x not between a - 1.5 * (b - a) and b + 1.5 * (b - a) outlier from s join q using (unit)),
 k(unit, rn, id, m) as (select distinct unit, 0::bigint, null::bigint, null::double from v union all select v.unit, v.rn, v.id, case when v.x is null or v.outlier then k.m else coalesce(0.9 * k.m + 0.1 * v.x, v.x) end from k join v on v.unit = k.unit and v.rn = k.rn + 1)
 select k.id, m ema, outlier from k join v on v.id = k.id""", "ema")
def _(spark, d):
    return R.adaptive_ema(samples(spark, d), ["unit"], "xm", ORDER, 604800.0).select("id", "ema", "outlier")


@query("time_resets", """, g as (select id, unit, t, t - lag(t) over (partition by unit order by id) dt from s) select id, dt, coalesce(dt < 0, false) is_reset, coalesce(dt = 0, false) is_tie, (count(*) filter (dt < 0) over (partition by unit order by id))::bigint segment from g""", "dt")
def _(spark, d):
    return S.time_resets(samples(spark, d), ["unit"], "t", ["id"]).select("id", "dt", "is_reset", "is_tie", "segment")


@query("session_split", """, g as (select id, unit, t, t - lag(t) over (partition by unit order by t, id) dt from s) select id, 1 + (count(*) filter (dt > 1800) over (partition by unit order by t, id rows unbounded preceding))::bigint as session from g""")
def _(spark, d):
    return S.sessions(samples(spark, d), ["unit"], "t", ORDER, 1800.0).select("id", "session")


@query("merge_recordings", """, r as (select unit, min(t) t0, max(t) - min(t) + 1.0 len from s group by unit), o as (select unit, t0, coalesce(sum(len) over (order by unit rows between unbounded preceding and 1 preceding), 0) a from r) select id, a + t - t0 merged_t from s join o using (unit)""", "merged_t")
def _(spark, d):
    return S.merge_recordings(samples(spark, d), "unit", "t").select("id", "merged_t")


@query("chunks", """, g as (select unit, t, min(t) over (partition by unit) t0 from s), c as (select *, floor((t - t0) / 604800)::bigint + 1 as chunk from g) select unit, chunk, count(*) n, min(t) as start, max(t) as stop, max(t) >= any_value(t0) + chunk * 604800 as complete from c group by unit, chunk""", "start stop")
def _(spark, d):
    return S.chunks(samples(spark, d), ["unit"], "t", 604800.0)


@query("stabilization_period", "select id, t < min(t) over (partition by unit) + 604800 settling from s")
def _(spark, d):
    return S.stabilization(samples(spark, d), ["unit"], "t", 604800.0).select("id", "settling")


@query("bilateral_asymmetry", """with l as (select l_orderkey, l_linenumber, l_extendedprice a, l_quantity * 1000 b from lineitem) select l_orderkey, l_linenumber, a - b as diff, (a - b) / (a + b) share, ln(a / b) log_ratio from l""", "diff share log_ratio")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000).alias("b"))
    return S.asymmetry(x, "a", "b").drop("a", "b")


@query("residual_on_predictor", """with f as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) b, avg(l_quantity) m, avg(l_extendedprice) y from lineitem group by l_returnflag)
 select l_orderkey, l_linenumber, l_extendedprice - b * (l_quantity - m) residual, y fit_mean from lineitem join f using (l_returnflag)""", "residual fit_mean")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    return S.linear_residual(x, ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "residual", "fit_mean")


@query("hampel_correction", """, a as (select *, x - quantile_cont(x, 0.5) over w r, quantile_cont(x, 0.5) over w m from s window w as (partition by unit order by t, id rows between 2 preceding and 2 following)), c as (select unit, median(r) c, 1.4826 * mad(r) k from a group by unit)
 select id, abs(r - c) > 3 * k replaced, case when abs(r - c) > 3 * k then m else x end clean from a join c using (unit)""", "clean")
def _(spark, d):
    return S.hampel(samples(spark, d), ["unit"], "x", ORDER, 5, 3.0).select("id", "replaced", "clean")


@query("anonymized_ids", "select id, 'P' || lpad((dense_rank() over (order by unit))::varchar, 4, '0') anon from s")
def _(spark, d):
    return S.anonymize(samples(spark, d), "unit").select("id", "anon")


# --- flags and audits ---------------------------------------------------------


@query("dropout_flags", """, g as (select *, row_number() over (partition by unit order by t, id) rn, round(x) v from s), a as (select *, rn - row_number() over (partition by unit, xm is null order by rn) k, coalesce(v = lag(v) over (partition by unit order by rn), false) f from g),
 b as (select *, rn - row_number() over (partition by unit, f order by rn) q from a) select id, xm is null and count(*) over (partition by unit, xm is null, k) >= 3 missing_dropout, f and count(*) over (partition by unit, f, q) >= 1 flat_dropout from b""")
def _(spark, d):
    a = Q.dropouts(samples(spark, d).withColumn("v", F.round("x")), ["unit"], "xm", ORDER, 3, 99).drop("flat_dropout").withColumnRenamed("missing_dropout", "missing")
    return Q.dropouts(a, ["unit"], "v", ORDER, 3, 1).select("id", F.col("missing").alias("missing_dropout"), "flat_dropout")


@query("nonwear_intervals", """, g as (select *, case when xm is null then 'missing' when xm = 0 then 'zero' when xm = lag(xm) over (partition by unit order by t, id) then 'constant' else 'worn' end kind, row_number() over (partition by unit order by t, id) rn from s),
 r as (select unit, kind, rn - row_number() over (partition by unit, kind order by rn) k, t from g) select unit, kind, count(*) n, min(t) as start, max(t) as stop from r where kind <> 'worn' group by unit, kind, k having count(*) >= 4""", "start stop")
def _(spark, d):
    return Q.nonwear(samples(spark, d), ["unit"], "xm", "t", ORDER, 4)


@query("signal_activity", """select unit, count(*) n_rows, count(xm) n_valid, stddev_samp(xm) sd, case when count(xm) = 0 then 'missing' when max(abs(xm)) = 0 then 'all_zero' when min(xm) = max(xm) then 'constant' when stddev_samp(xm) < 20 then 'low_variation' else 'active' end status from s group by unit""", "sd")
def _(spark, d):
    return Q.signal_activity(samples(spark, d), ["unit"], "xm", 20.0)


@query("missingness_by_column", """, u as (select 'x' as column, x v from s union all select 'xm', xm from s union all select 'h', h::double from s)
 select "column", count(*) n_rows, count(*) filter (v is null) n_missing, count(*) filter (v = 0) n_zero, min(v) min, max(v) max, 100.0 * count(*) filter (v is null) / count(*) missing_pct from u group by "column" """, "min max missing_pct")
def _(spark, d):
    return Q.missingness(samples(spark, d), ["x", "xm", "h"])


@query("channel_audit", """, u as (select *, abs(xm - lag(xm) over (partition by unit order by t, id)) st from s where xm <> 0) select unit, count(*) usable, count(*) filter (xm not between 70 and 200) out_of_range, count(*) filter (st > 80) jumps, count(*) filter (st = 0) flat_steps, min(xm) min, max(xm) max from u group by unit""", "min max")
def _(spark, d):
    return Q.channel_audit(samples(spark, d), ["unit"], "xm", ORDER, 70.0, 200.0, 80.0)


@query("conductance_conversion", "with l as (select l_orderkey, l_linenumber, l_extendedprice - 30000 r from lineitem) select l_orderkey, l_linenumber, case when r > 0 then 1e6 / r end ohm, case when r > 0 then 1e3 / r end kohm from l", "ohm kohm")
def _(spark, d):
    r = F.col("l_extendedprice") - 30000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Q.to_conductance(r, "ohm").alias("ohm"), Q.to_conductance(r, "kohm").alias("kohm"))


@query("eda_artifacts", """, g as (select *, xm - lag(xm) over w st, (xm - lag(xm) over w) / nullif(t - lag(t) over w, 0) sl from s window w as (partition by unit order by t, id)), m as (select unit, median(st) c, 1.4826 * mad(st) k from g group by unit),
 f as (select id, st as step, concat_ws(';', case when xm is null then 'missing' end, case when xm < 0 then 'negative' end, case when xm not between 70 and 250 then 'bounds' end, case when abs(sl) > 0.01 then 'slope' end, case when k > 0 and abs(st - c) > 2 * k then 'jump' end) reasons from g join m using (unit))
 select *, reasons <> '' artifact from f""", "step")
def _(spark, d):
    return Q.eda_artifacts(samples(spark, d), ["unit"], "xm", "t", ORDER, 70.0, 250.0, 0.01, 2.0).select("id", "step", "reasons", "artifact")


@query("rr_outliers", """, m as (select unit, median(x) c, 1.4826 * mad(x) k, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 i from s group by unit) select id, x not between 20 and 300 out_of_range, (case when k > 0 then k else i end) > 0 and abs(x - c) > 2.5 * (case when k > 0 then k else i end) outlier from s join m using (unit)""")
def _(spark, d):
    return Q.rr_outliers(samples(spark, d), ["unit"], "x", 20.0, 300.0, 2.5).select("id", "out_of_range", "outlier")


@query("ibi_quality", """select id, case when xm is null then 'missing' when xm <= 0 then 'nonpositive' when xm not between 65 and 220 then 'range' when abs(xm - lag(xm) over (partition by unit order by t, id)) > 60 then 'jump' else 'ok' end status from s""")
def _(spark, d):
    return Q.ibi_quality(samples(spark, d), ["unit"], "xm", ORDER, 65.0, 220.0, 60.0).select("id", "status")


@query("ibi_implausible", """, g as (select *, lag(xm) over (partition by unit order by t, id) w from s), f as (select *, coalesce(xm not between 65 and 220 or coalesce(abs(xm - w) / case when w > 0 then w end > 0.8, false), true) implausible from g) select id, implausible, case when not implausible then xm end clean from f""", "clean")
def _(spark, d):
    return Q.ibi_implausible(samples(spark, d), ["unit"], "xm", ORDER, 65.0, 220.0, 0.8).select("id", "implausible", "clean")


@query("hr_ibi_consistency", """, g as (select unit, abs(x - 60000.0 / case when h > 0 then h * 50 end) d from s) select unit, count(d) n, avg(d) mean_diff, max(d) max_diff, count(*) filter (d <= 60) / count(d)::double agree from g group by unit""", "mean_diff max_diff agree")
def _(spark, d):
    s = samples(spark, d).withColumn("ibi", F.when(F.col("h") > 0, F.col("h") * 50.0))
    return Q.hr_ibi_consistency(s, ["unit"], "x", "ibi", 60.0)


@query("local_correction", """, g as (select *, quantile_cont(x, 0.5) over (partition by unit order by t, id rows between 3 preceding and 3 following) m from s) select id, m as local, abs(x - m) > 0.5 * m artifact, case when abs(x - m) > 0.5 * m then m else x end corrected from g""", "local corrected")
def _(spark, d):
    return Q.local_correction(samples(spark, d), ["unit"], "x", ORDER, 3, 0.5).select("id", "local", "artifact", "corrected")


@query("blink_intervals", """, g as (select *, coalesce(xm <= 0, true) b, row_number() over (partition by unit order by t, id) rn from s), r as (select unit, b, t, rn - row_number() over (partition by unit, b order by rn) k from g)
 select unit, min(t) onset, max(t) as offset_t, count(*) n, max(t) - min(t) duration from r where b group by unit, k having max(t) - min(t) >= 3600""", "onset offset_t duration")
def _(spark, d):
    return Q.blinks(samples(spark, d), ["unit"], "xm", "t", ORDER, 3600.0).withColumnRenamed("offset", "offset_t")


@query("artifact_dilation", "select id, max((xm is null)::int) over (partition by unit order by t, id rows between 2 preceding and 1 following) = 1 dilated from s")
def _(spark, d):
    return Q.dilated(samples(spark, d).withColumn("f", F.col("xm").isNull()), ["unit"], "f", ORDER, 1, 2).select("id", "dilated")


@query("gaze_filter", """, g as (select *, sqrt((xm - lag(xm) over w) ** 2 + (h - lag(h) over w) ** 2) / nullif(t - lag(t) over w, 0) v from s window w as (partition by unit order by t, id)),
 f as (select *, concat_ws(';', case when xm is null then 'missing' end, case when not (xm between 70 and 200 and h between 2 and 20) then 'bounds' end, case when v > 0.01 then 'velocity' end) reasons from g)
 select id, v velocity, reasons, case when reasons = '' then xm end gaze_x, case when reasons = '' then h end::double gaze_y from f""", "velocity gaze_x gaze_y")
def _(spark, d):
    s = samples(spark, d).withColumn("h", F.col("h").cast("double"))
    return Q.gaze_filter(s, ["unit"], "xm", "h", "t", ORDER, (70, 2, 200, 20), 0.01).select("id", "velocity", "reasons", "gaze_x", "gaze_y")


@query("sampling_irregularity", """, g as (select unit, t - lag(t) over (partition by unit order by t, id) dt from s), m as (select unit, median(dt) filter (dt > 0) st from g group by unit)
 select unit, count(*) n, any_value(st) step, stddev_samp(dt) filter (dt > 0) jitter, count(*) filter (dt = 0) repeats, count(*) filter (dt < 0) backward, count(*) filter (dt > 1.5 * st) gaps, coalesce(sum(round(dt / st) - 1) filter (dt > 1.5 * st), 0)::bigint lost from g join m using (unit) group by unit""", "step jitter")
def _(spark, d):
    return Q.sampling(samples(spark, d), ["unit"], "t", ORDER)


@query("quality_classes", """, w as (select unit, count(xm) / count(*)::double p, stddev_samp(xm) sd, count(*) n from s group by unit), f as (select *, (p < 0.55)::int + coalesce((sd < 45)::int, 0) + (n < 60)::int failed from w)
 select unit, failed, case failed when 0 then 'pass' when 1 then 'review' else 'exclude_candidate' end as class, concat_ws('|', case when p < 0.55 then 'missing' end, case when sd < 45 then 'flat' end, case when n < 60 then 'short' end) why from f""")
def _(spark, d):
    w = samples(spark, d).groupBy("unit").agg((F.count("xm") / F.count("*")).alias("p"), F.stddev_samp("xm").alias("sd"), F.count("*").alias("n"))
    return Q.classify(w, {"missing": F.col("p") < 0.55, "flat": F.col("sd") < 45, "short": F.col("n") < 60}).select("unit", "failed", "class", "why")


@query("eda_response_pattern", "select unit, count(x) n, avg(abs(x)) mean_abs, max(abs(x)) max_abs, case when avg(abs(x)) < 60 then 'hypo' when avg(abs(x)) > 120 then 'hyper' else 'typical' end pattern from s group by unit", "mean_abs max_abs")
def _(spark, d):
    return Q.response_pattern(samples(spark, d), ["unit"], "x", 60.0, 120.0)


@query("eda_nonresponders", "select unit, count(*) trials, count(*) filter (x > 100) responses, count(*) filter (x > 100) / count(*)::double rate, count(*) filter (x > 100) / count(*)::double < 0.3 nonresponder from s group by unit", "rate")
def _(spark, d):
    return Q.nonresponders(samples(spark, d), "unit", F.col("x") > 100, 0.3)


@query("psi_drift", """with e as (select quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q from lineitem where l_returnflag = 'N'), b as (select l_returnflag, year(l_shipdate) y, len([z for z in q if z < l_extendedprice]) bin from lineitem, e),
 r as (select bin, greatest(count(*) / sum(count(*)) over (), 1e-6) p from b where l_returnflag = 'N' group by bin), g as (select y, bin, greatest(count(*) / sum(count(*)) over (partition by y), 1e-6) q from b group by y, bin)
 select c.y as year, sum((coalesce(q, 1e-6) - p) * ln(coalesce(q, 1e-6) / p)) psi from (select distinct y from b) c cross join r left join g on g.y = c.y and g.bin = r.bin group by c.y""", "psi")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    return Q.psi_drift(x.where("l_returnflag = 'N'"), x, "year", "l_extendedprice")


@query("session_comparability", """, m as (select unit, 'x' metric, avg(x) mean from s group by unit union all select unit, 'xm', avg(xm) from s group by unit), c as (select metric, avg(mean) a, stddev_samp(mean) b, quantile_cont(mean, 0.25) q1, quantile_cont(mean, 0.75) q3 from m group by metric)
 select unit, metric, mean, (mean - a) / b z, mean not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) outlier from m join c using (metric)""", "mean z")
def _(spark, d):
    return Q.session_comparability(samples(spark, d), "unit", ["x", "xm"])


@query("experiment_design_cube", "with o as (select o_orderpriority, o_orderstatus from orders) select o_orderpriority, o_orderstatus, (grouping(o_orderpriority) * 2 + grouping(o_orderstatus))::bigint as level, count(*) n from o group by cube (o_orderpriority, o_orderstatus)")
def _(spark, d):
    return Q.experiment_design(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("event_coverage_missing", "select u.unit, k.state from (select distinct unit from s) u cross join (select distinct state from s) k where not exists (select 1 from s where s.unit = u.unit and s.state = k.state)")
def _(spark, d):
    s = samples(spark, d)
    return Q.event_coverage(s, "unit", "state", s.select("state").distinct())


@query("condition_balance", ", n as (select unit, state, count(*) n from s group by unit, state) select unit, count(*) conditions, min(n) least, max(n) most, max(n) / min(n)::double imbalance from n group by unit", "imbalance")
def _(spark, d):
    return Q.condition_balance(samples(spark, d), "unit", "state")


@query("group_correlation", "with l as (select l_returnflag, l_linestatus, l_extendedprice a, l_quantity b from lineitem) select l_returnflag, l_linestatus, count(*) n, corr(a, b) r, abs(corr(a, b)) > 0.5 flagged from l group by 1, 2", "r")
def _(spark, d):
    return Q.group_correlation(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", 0.5)


# --- joins and alignment ------------------------------------------------------


@query("sync_exact_join", "with j as (select l_orderkey, l_linenumber, o_orderstatus, o_totalprice from lineitem left join orders on l_orderkey = o_orderkey) select * from j", "o_totalprice")
def _(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return J.sync(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("ttl_change_events", """, g as (select *, lag(state) over (partition by unit order by t, id) previous, row_number() over (partition by unit order by t, id) rn from s) select id, unit, state, previous, row_number() over (partition by unit order by t, id) event_order from g where rn = 1 or state <> previous""")
def _(spark, d):
    return J.change_events(samples(spark, d), ["unit"], "state", ORDER).select("id", "unit", "state", "previous", "event_order")


def _anchors(spark, d):
    return samples(spark, d).where("state = 'error'").select("unit", F.col("id").alias("event"), F.col("t").alias("et"))


@query("event_aligned_samples", "select e.id as event, s.id, s.t - e.t rel from s e join s on e.unit = s.unit and s.t between e.t - 36000 and e.t + 36000 where e.state = 'error'", "rel")
def _(spark, d):
    return J.align_to_events(_anchors(spark, d), samples(spark, d), ["unit"], "et", "t", 36000.0, 36000.0).select("event", "id", "rel")


@query("event_window_stats", """, e as (select id as event, unit, t et from s where state = 'error'), a as (select event, count(*) n, avg(xm) mean, stddev_samp(xm) sd, min(xm) min, max(xm) max, count(*) filter (xm is null) n_missing from e join s on e.unit = s.unit and t between et + 1 and et + 36000 group by event)
 select event, coalesce(n, 0) n, mean, sd, min, max, coalesce(n_missing, 0) n_missing from e left join a using (event)""", "mean sd min max")
def _(spark, d):
    return J.event_windows(_anchors(spark, d), samples(spark, d), ["unit"], "event", "et", "t", "xm", -1.0, 36000.0)


@query("event_locked_summary", """, a as (select e.id as event, s.t - e.t rel, s.x, avg(s.x) filter (s.t < e.t) over (partition by e.id) b from s e join s on e.unit = s.unit and s.t between e.t - 36000 and e.t + 36000 where e.state = 'error'),
 p as (select *, x - coalesce(b, 0) y from a where rel >= 0), q as (select *, lead(rel) over w r2, lead(y) over w y2 from p window w as (partition by event order by rel, x))
 select event, any_value(b) baseline, max(y) peak, arg_max(rel, (y, -rel)) latency, sum((y + y2) / 2 * (r2 - rel)) area, count(y) n from q group by event""", "baseline peak latency area")
def _(spark, d):
    return J.event_locked(_anchors(spark, d), samples(spark, d), ["unit"], "event", "et", "t", "x", 36000.0, 36000.0)


@query("clock_alignment_fit", """with p as (select o_custkey % 50 k, date_diff('day', date '1990-01-01', o_orderdate::date)::double r, date_diff('day', date '1990-01-01', l_shipdate::date)::double g from orders join lineitem on o_orderkey = l_orderkey),
 f as (select k, count(*) n, regr_slope(r, g) slope, regr_intercept(r, g) intercept, median(r - g) as offset_t from p group by k) select f.*, (select stddev_samp(r - intercept - slope * g) from p where p.k = f.k) residual_sd from f""", "slope intercept offset_t residual_sd")
def _(spark, d):
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date")).cast("double")
    p = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 50).alias("k"), day("o_orderdate").alias("r"), day("l_shipdate").alias("g"))
    return J.clock_fit(p, ["k"], "r", "g").withColumnRenamed("offset", "offset_t")


@query("nearest_sample_merge", """, l as (select * from s where state = 'error'), r as (select unit, t, min(x) filter (true) x from s where state = 'view' group by unit, t),
 b as (select l.id, l.unit, l.t, r.t t1, r.x x1 from l asof left join r on l.unit = r.unit and l.t >= r.t), n as (select b.*, r.t t2, r.x x2 from b asof left join r on b.unit = r.unit and b.t <= r.t),
 m as (select *, case when t2 is null or (t1 is not null and t - t1 <= t2 - t) then t1 else t2 end mt, case when t2 is null or (t1 is not null and t - t1 <= t2 - t) then x1 else x2 end mx from n)
 select unit, id, t, case when abs(mt - t) <= 36000 then mt end match_t, case when abs(mt - t) <= 36000 then mx end match_x from m""", "t match_t match_x")
def _(spark, d):
    s = samples(spark, d)
    return J.nearest(s.where("state = 'error'"), s.where("state = 'view'"), ["unit"], "t", "id", "x", 36000.0)


@query("signal_lag", """, g as (select unit, x, h::double y, row_number() over (partition by unit order by t, id) rn from s), r as (select a.unit, k lag, count(*) n, corr(a.x, b.y) r from g a cross join (select unnest(range(-4, 5)) k) join g b on a.unit = b.unit and b.rn = a.rn + k group by a.unit, k having count(*) >= 5)
 select unit, arg_max(lag, (round(abs(r), 9), -abs(lag), lag)) filter (r is not null) best_lag, max(abs(r)) best_r from r group by unit""", "best_r")
def _(spark, d):
    return J.lag_correlation(samples(spark, d).withColumn("y", F.col("h").cast("double")), ["unit"], "x", "y", ORDER, 4)


@query("signal_correlation", """, r as (select unit, xm, h, rank() over (partition by unit order by xm) + (count(*) over (partition by unit, xm) - 1) / 2.0 a, rank() over (partition by unit order by h) + (count(*) over (partition by unit, h) - 1) / 2.0 b from s where xm is not null)
 select unit, count(*) n, corr(xm, h) pearson, corr(a, b) spearman from r group by unit""", "pearson spearman")
def _(spark, d):
    return J.rank_correlation(samples(spark, d).withColumn("h", F.col("h").cast("double")), ["unit"], "xm", "h")


@query("sync_drift", """with p as (select o_orderpriority k, date_diff('day', date '1990-01-01', o_orderdate::date)::double r, date_diff('day', date '1990-01-01', l_shipdate::date)::double g from orders join lineitem on o_orderkey = l_orderkey)
 select k, count(*) n, regr_slope(g - r, r) drift, stddev_samp(g - r) sd, max(g - r) - min(g - r) as range, max(g - r) - min(g - r) <= 100 ok from p group by k""", "drift sd range")
def _(spark, d):
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date")).cast("double")
    p = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("k"), day("o_orderdate").alias("r"), day("l_shipdate").alias("g"))
    return J.sync_drift(p, ["k"], "r", "g", 100.0)


@query("area_assignment", """with a as (select * from (values ('small', 1.0, 20.0, 900.0, 1200.0, 2), ('large', 0.0, 50.0, 900.0, 1900.0, 1), ('right', 30.0, 50.0, 1000.0, 1500.0, 2)) v(aoi, xmin, xmax, ymin, ymax, priority)),
 h as (select p_partkey, aoi, row_number() over (partition by p_partkey order by priority desc, (xmax - xmin) * (ymax - ymin), aoi) k, count(aoi) over (partition by p_partkey) n from part left join a on p_size between xmin and xmax and p_retailprice between ymin and ymax)
 select p_size, p_retailprice, aoi area, n n_areas from h join part using (p_partkey) where k = 1""")
def _(spark, d):
    areas = spark.createDataFrame([("small", 1.0, 20.0, 900.0, 1200.0, 2), ("large", 0.0, 50.0, 900.0, 1900.0, 1), ("right", 30.0, 50.0, 1000.0, 1500.0, 2)], "aoi string, xmin double, xmax double, ymin double, ymax double, priority int")
    p = table(spark, d, "part").select("p_size", "p_retailprice")  # without a key: equal points are points of their own
    return J.assign_area(p, areas, "p_size", "p_retailprice").select("p_size", "p_retailprice", "area", "n_areas")


# --- events ---------------------------------------------------------------------


@query("local_peaks", ", g as (select *, lag(x) over w p, lead(x) over w n from s window w as (partition by unit order by t, id)) select id, unit, x from g where x >= 50 and x > p and x >= n", "x")
def _(spark, d):
    return E.local_peaks(samples(spark, d), ["unit"], "x", ORDER, 50.0).select("id", "unit", "x")


@query("refractory_events", """with recursive s as (select user_id unit, epoch_us(ts) / 1e6 t from events), k(unit, t) as (select unit, min(t) from s group by unit union all select k.unit, (select min(s.t) from s where s.unit = k.unit and s.t - k.t >= 86400) from k where exists (select 1 from s where s.unit = k.unit and s.t - k.t >= 86400))
 select unit, t from k""", "t")
def _(spark, d):
    return R.refractory(samples(spark, d), ["unit"], "t", 86400.0)


@query("habituation", """, g as (select *, row_number() over w trial, ntile(3) over w third from s window w as (partition by unit order by t, id)) select unit, count(*) n, regr_slope(ln(1 + x), trial) slope, avg(x) filter (third = 3) / nullif(avg(x) filter (third = 1), 0) ratio from g group by unit""", "slope ratio")
def _(spark, d):
    return E.habituation(samples(spark, d), ["unit"], "x", ORDER)


IVT = """, a as (select *, t - lag(t) over w dt, case when t - lag(t) over w > 0 and t - lag(t) over w <= 200000 then sqrt((x - lag(x) over w) ** 2 + (h - lag(h) over w) ** 2) / (t - lag(t) over w) end v0 from s window w as (partition by unit order by t, id)),
 b as (select *, greatest(v0, lead(v0) over w) v, coalesce(dt > 200000 or lead(dt) over w > 200000, false) gap, row_number() over w rn from a window w as (partition by unit order by t, id)), c as (select *, case when v is null or gap then 'none' when v <= 0.002 then 'fixation' else 'saccade' end class from b),
 r as (select *, rn - row_number() over (partition by unit, class order by rn) k from c) select unit, min(t) as start, max(t) as stop, count(*) n, avg(x) x, avg(h) y, max(t) - min(t) duration from r where class = '{k}' group by unit, k having max(t) - min(t) >= {m}"""


@query("ivt_fixations", IVT.format(k="fixation", m=3600), "start stop x y duration")
def _(spark, d):
    return E.fixations(samples(spark, d).withColumn("h", F.col("h").cast("double")), ["unit"], "x", "h", "t", ORDER, 0.002, 200000.0, 3600.0)


@query("ivt_saccades", IVT.format(k="saccade", m=0), "start stop x y duration")
def _(spark, d):
    return E.fixations(samples(spark, d).withColumn("h", F.col("h").cast("double")), ["unit"], "x", "h", "t", ORDER, 0.002, 200000.0, 0.0, "saccade")


@query("marker_onsets", """, g as (select *, state = 'view' a, lag(state = 'view') over w was, min(case when state <> 'view' then rn end) over (partition by unit order by rn rows between 1 following and unbounded following) nr from (select *, row_number() over (partition by unit order by t, id) rn from s) window w as (partition by unit order by rn))
 select g.id, n.t - g.t duration from g left join (select unit, rn, t from g) n on n.unit = g.unit and n.rn = g.nr where a and not coalesce(was, false)""", "duration")
def _(spark, d):
    return E.marker_onsets(samples(spark, d), ["unit"], F.col("state") == "view", "t", ORDER).select("id", "duration")


@query("combined_markers", "select unit, floor(t / 86400)::bigint as day, array_to_string(list_sort(list(distinct state)), '+') markers, count(*) n from s group by unit, floor(t / 86400)")
def _(spark, d):
    return E.combine_markers(samples(spark, d).withColumn("day", F.floor(F.col("t") / 86400).cast("long")), ["unit"], "day", "state")


@query("changepoints", """, g as (select *, abs(avg(x) over (partition by unit order by t, id rows between 1 following and 5 following) - avg(x) over (partition by unit order by t, id rows between 5 preceding and 1 preceding)) score from s), l as (select *, 2 * avg(score) over (partition by unit) lim from g) select id, score from l where score > lim""", "score")
def _(spark, d):
    return E.changepoints(samples(spark, d), ["unit"], "x", ORDER, 5, 2.0).select("id", "score")


@query("scr_interval_classes", ", e as (select id, extract(minute from to_timestamp(t)) / 4.0 lat from s) select id, lat, case when lat >= 1 and lat < 5 then 'FIR' when lat >= 5 and lat < 9 then 'SIR' when lat >= 9 and lat <= 12 then 'TIR' end as interval from e", "lat")
def _(spark, d):
    s = samples(spark, d).withColumn("lat", F.floor(F.pmod(F.col("t"), F.lit(3600.0)) / 60) / 4.0)
    return s.select("id", "lat", E.scr_interval(F.col("lat")).alias("interval"))


# --- variability ------------------------------------------------------------------

NN = ", v as (select unit, x, x - lag(x) over (partition by unit order by t, id) d, row_number() over (partition by unit order by t, id) rn from s where x > 0)"


@query("hrv_time_domain", NN + """ select unit, count(*) n, avg(x) mean_nn, min(x) min_nn, max(x) max_nn, stddev_samp(x) sdnn, sqrt(avg(d * d)) rmssd, stddev_samp(d) sdsd, count(*) filter (abs(d) > 50) nn50, count(*) filter (abs(d) > 20) nn20,
 100.0 * count(*) filter (abs(d) > 50) / nullif(count(d), 0) pnn50, 100.0 * count(*) filter (abs(d) > 20) / nullif(count(d), 0) pnn20, avg(60000 / x) mean_hr from v group by unit""", "mean_nn min_nn max_nn sdnn rmssd sdsd pnn50 pnn20 mean_hr")
def _(spark, d):
    return C.time_domain(samples(spark, d), ["unit"], "x", ORDER)


@query("hrv_segment_indices", ", v as (select unit, x, round(sum(x) over (partition by unit order by t, id rows unbounded preceding), 6) / 1000 c from s where x > 0), g as (select unit, floor(c / 2) k, avg(x) m, stddev_samp(x) sd from v group by unit, floor(c / 2)) select unit, count(*) segments, avg(sd)::decimal(28, 9) sdnn_index, stddev_samp(m)::decimal(28, 9) sdann from g group by unit", "sdnn_index sdann")
def _(spark, d):
    return halves(C.segment_indices(samples(spark, d), ["unit"], "x", ORDER, 2.0), "sdnn_index", "sdann")


@query("hrv_geometric", ", b as (select unit, floor(x / 7.8125)::bigint b, count(*) k from s where x > 0 group by 1, 2) select unit, sum(k) / max(k)::double triangular_index, (max(b) - min(b)) * 7.8125::double tinn from b group by unit", "triangular_index tinn")
def _(spark, d):
    return C.geometric(samples(spark, d), ["unit"], "x")


@query("hrv_poincare", NN + ", p as (select unit, count(d) n, sqrt(var_samp(d) / 2) sd1, sqrt(greatest(2 * var_samp(x) - var_samp(d) / 2, 0)) sd2 from v group by unit) select *, sd1 / nullif(sd2, 0) ratio, pi() * sd1 * sd2 area from p", "sd1 sd2 ratio area")
def _(spark, d):
    return C.poincare(samples(spark, d), ["unit"], "x", ORDER)


@query("hrv_fragmentation", NN + """, g as (select unit, sign(d)::int s, row_number() over (partition by unit order by rn) k from v where d <> 0), h as (select *, s * lag(s) over (partition by unit order by k) < 0 turn, k - row_number() over (partition by unit, s order by k) q from g),
 r as (select unit, s, q, count(*) len from h group by unit, s, q), i as (select unit, count(*) filter (turn) turns, count(*) n from h group by unit)
 select unit, 100.0 * any_value(turns) / nullif(any_value(n) - 1, 0) pip, 1 / avg(len) ials, 100.0 * coalesce(sum(len) filter (len <= 3), 0) / sum(len) pss, 100.0 * count(*) filter (len = 1) / sum(len) pas from r join i using (unit) group by unit""", "pip ials pss pas")
def _(spark, d):
    return C.fragmentation(samples(spark, d), ["unit"], "x", ORDER)


@query("hrv_asymmetry", NN + " select unit, count(*) filter (d < 0) accelerations, count(*) filter (d > 0) decelerations, 100.0 * sum(d * d) filter (d > 0) / sum(d * d) filter (d <> 0) guzik, 100.0 * count(*) filter (d < 0) / nullif(count(*) filter (d <> 0), 0) porta from v group by unit", "guzik porta")
def _(spark, d):
    return C.asymmetry(samples(spark, d), ["unit"], "x", ORDER)


@query("hrv_lomb_power", """, c as (select unit, x - avg(x) over (partition by unit) y, h t from s), g as (select *, 2 * pi() * f * t w from c, (values (0.05::double), (0.1), (0.2), (0.3)) v(f))
 select unit, f, 0.5 * (coalesce(sum(y * cos(w)) ** 2 / nullif(sum(cos(w) ** 2), 0), 0) + coalesce(sum(y * sin(w)) ** 2 / nullif(sum(sin(w) ** 2), 0), 0)) power from g group by unit, f""", "f power")
def _(spark, d):
    return C.lomb(samples(spark, d), ["unit"], "x", "h", [0.05, 0.1, 0.2, 0.3])


@query("kalman_fusion", """with recursive s as (select event_id id, user_id unit, case when value >= 60 then value end a, case when event_id % 3 = 0 then value end b, row_number() over (partition by user_id order by ts, event_id) rn from events),
 k(unit, rn, id, m, p) as (select distinct unit, 0::bigint, null::bigint, null::double, 1.0::double from s union all
 select unit, rn, id, case when b is null then m1 else coalesce(m1, b) + p1 / (p1 + 3.0) * (b - coalesce(m1, b)) end, case when b is null then p1 else (1 - p1 / (p1 + 3.0)) * p1 end from
 (select s.unit, s.rn, s.id, s.b, case when s.a is null then k.m else coalesce(k.m, s.a) + (k.p + 0.1) / (k.p + 0.1 + 2.0) * (s.a - coalesce(k.m, s.a)) end m1, case when s.a is null then k.p + 0.1 else (1 - (k.p + 0.1) / (k.p + 0.1 + 2.0)) * (k.p + 0.1) end p1
 from k join s on s.unit = k.unit and s.rn = k.rn + 1))
 select k.id, m as fused, p variance, case when a is null and b is null then 'missing' when b is null then 'primary_only' when a is null then 'secondary_only' else 'fused' end status from k join s on s.id = k.id""", "fused variance")
def _(spark, d):
    s = samples(spark, d).withColumn("b", F.when(F.col("id") % 3 == 0, F.col("x")))
    return R.fuse_two(s, ["unit"], "xm", "b", ORDER, 604800.0, 0.1, 2.0, 3.0).select("id", "fused", "variance", "status")


RUNS = """p as (select {k}, v, rn, count(*) over (partition by {k}) n, 0.2 * stddev_samp(v) over (partition by {k}) tol from {src}), c as (select {b}, b.rn - a.rn lag, b.rn as pos from p a join p b on {on} and a.rn < b.rn and abs(a.v - b.v) <= a.tol and a.tol > 0),
 d as (select *, pos - row_number() over (partition by {k}, lag order by pos) run from c), runs as (select {k}, lag, run, count(*) len, max(pos) as last from d group by {k}, lag, run), size as (select {k}, count(*) n, any_value(tol) tol from p group by {k}),
 ab as (select {r}, sum(greatest(len - 1, 0) - case when last = n and len >= 2 then 1 else 0 end) b, sum(greatest(len - 2, 0)) a from runs r join size using ({k}) group by {r})"""
PLACES = ", v0 as (select unit, x v, row_number() over (partition by unit order by t, id) rn from s where x is not null), "
BY_UNIT = RUNS.format(k="unit", b="b.unit", r="unit", on="a.unit = b.unit", src="v0")


@query("hrv_nonlinear", PLACES + BY_UNIT + """, e as (select size.unit, n, case when a > 0 and b > 0 then -ln(a / b) end sampen from size left join ab using (unit)),
 y as (select unit, rn - 1 as pos, count(*) over (partition by unit) n, sum(v - m) over (partition by unit order by rn) y from (select *, avg(v) over (partition by unit) m from v0)), z as (select *, pos // size box from y, (select unnest([4, 6, 8, 12, 16, 24, 32]) size) where n >= 2 * size and pos < n - n % size),
 q as (select unit, size, box, regr_syy(y, pos) - regr_sxy(y, pos) ** 2 / regr_sxx(y, pos) rest from z group by all), f as (select unit, size, greatest(avg(rest), 0) / size f2 from q group by unit, size), g as (select unit, regr_slope(ln(f2) / 2, ln(size)) dfa from f where f2 > 1e-18 group by unit having count(*) > 1)
 select unit, n, sampen, dfa from e left join g using (unit)""", "sampen dfa")
def _(spark, d):
    s = samples(spark, d)
    e = Y.sample_entropy(s, ["unit"], "x", ORDER).withColumnRenamed("entropy", "sampen")
    return e.join(Y.detrended_fluctuation(s, ["unit"], "x", ORDER), "unit", "left")


# --- statistics and model tables ---------------------------------------------------


@query("device_agreement", """with l as (select l_returnflag k, l_extendedprice / 1500 a, l_quantity b from lineitem) select k, count(*) n, avg(a - b) bias, stddev_samp(a - b) sd, avg(abs(a - b)) mae, sqrt(avg((a - b) ** 2)) rmse,
 2 * covar_samp(a, b) / (var_samp(a) + var_samp(b) + (avg(a) - avg(b)) ** 2) ccc, avg(a - b) - 1.96 * stddev_samp(a - b) low, avg(a - b) + 1.96 * stddev_samp(a - b) high from l group by k""", "bias sd mae rmse ccc low high")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_extendedprice") / 1500).alias("a"), F.col("l_quantity").alias("b"))
    return T.agreement(x, ["k"], "a", "b")


@query("scr_responsivity", ", r as (select unit, count(*) n, count(*) filter (x > 100) k from s group by unit) select *, (k + 1) / (n + 2.0) posterior_mean, sqrt((k + 1) * (n - k + 1) / ((n + 2.0) ** 2 * (n + 3))) posterior_sd from r", "posterior_mean posterior_sd")
def _(spark, d):
    return T.responsivity(samples(spark, d), "unit", F.col("x") > 100)


TMAP = """with c as (select o_custkey % 100 s, month(o_orderdate) m, avg(o_totalprice) filter (o_orderpriority = '1-URGENT') a, avg(o_totalprice) filter (o_orderpriority = '5-LOW') b from orders group by 1, 2),
 g as (select m, count(*) n, avg(b - a) mean, stddev_samp(b - a) sd from c where a is not null and b is not null group by m), t as (select m as time, n, mean, sd, case when sd > 0 then mean / (sd / sqrt(n)) else 0 end t from g)"""


def _cells(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("subject"), F.col("o_orderpriority").alias("condition"), F.month("o_orderdate").alias("time"), F.col("o_totalprice").alias("x"))


LEVELS = ("1-URGENT", "5-LOW")


@query("cluster_t_map", TMAP + " select * from t", "mean sd t")
def _(spark, d):
    return T.paired_t_by_time(_cells(spark, d), "subject", "condition", "time", "x", LEVELS)


@query("cluster_masses", TMAP + """, g2 as (select *, case when t > 0.3 then 1 when t < -0.3 then -1 else 0 end sg, row_number() over (order by time) rn from t), r as (select *, rn - row_number() over (partition by sg order by rn) k from g2)
 select sg as sign, min(time) as start, max(time) as stop, count(*) size, sum(t) mass from r where sg <> 0 group by sg, k""", "mass")
def _(spark, d):
    return T.time_clusters(T.paired_t_by_time(_cells(spark, d), "subject", "condition", "time", "x", LEVELS), "time", 0.3)


CELLS = """with c as (select o_custkey % 100 s, month(o_orderdate) m, avg(o_totalprice) filter (o_orderpriority = '5-LOW') - avg(o_totalprice) filter (o_orderpriority = '1-URGENT') d from orders group by 1, 2),
 f as (select round, m, d * (1 - 2 * (('0x' || substr(md5('1|' || round || '|' || s), 1, 8))::bigint % 2)) d from c, range(1, 101) r(round) where d is not null),
 t as (select round, m, case when stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) else 0 end t from f group by round, m),
 g as (select *, case when t > 0.3 then 1 when t < -0.3 then -1 else 0 end sg, row_number() over (partition by round order by m) rn from t), h as (select *, rn - row_number() over (partition by round, sg order by rn) k from g),
 u as (select round, abs(sum(t)) mass from h where sg <> 0 group by round, sg, k), null_mass as (select round::int as round, coalesce(max(u.mass), 0) mass from (select distinct round from f) left join u using (round) group by round)"""


@query("cluster_permutation_null", CELLS + " select * from null_mass", "mass")
def _(spark, d):
    return T.cluster_null(_cells(spark, d), "subject", "condition", "time", "x", LEVELS, 0.3, 100)


OBSERVED = """, o as (select m, avg(d) / (stddev_samp(d) / sqrt(count(*))) t from c where d is not null group by m)"""


@query("cluster_threshold_sensitivity", CELLS + OBSERVED + """, l as (select unnest([0.2, 0.3, 0.5])::double as limit_t), z as (select limit_t, m, t, case when t > limit_t then 1 when t < -limit_t then -1 else 0 end sg from o, l),
 y as (select *, row_number() over (partition by limit_t order by m) - row_number() over (partition by limit_t, sg order by m) k from z), x as (select limit_t, abs(sum(t)) mass from y where sg <> 0 group by limit_t, sg, k)
 select l.limit_t, count(mass) clusters, coalesce(max(mass), 0) largest from l left join x using (limit_t) group by l.limit_t""", "limit_t largest")
def _(spark, d):
    return T.threshold_sensitivity(T.paired_t_by_time(_cells(spark, d), "subject", "condition", "time", "x", LEVELS), "time", [0.2, 0.3, 0.5])


@query("cluster_p_values", CELLS + OBSERVED + """, z as (select m, t, case when t > 0.3 then 1 when t < -0.3 then -1 else 0 end sg from o), y as (select *, row_number() over (order by m) - row_number() over (partition by sg order by m) k from z),
 x as (select sg as sign, min(m) as start, sum(t) mass from y where sg <> 0 group by sg, k) select x.sign, x.start, x.mass, (1 + (select count(*) from null_mass n where n.mass >= abs(x.mass))) / 101.0 p from x""", "mass p")
def _(spark, d):
    cells = _cells(spark, d)
    masses = T.time_clusters(T.paired_t_by_time(cells, "subject", "condition", "time", "x", LEVELS), "time", 0.3)
    return M.cluster_p(masses, T.cluster_null(cells, "subject", "condition", "time", "x", LEVELS, 0.3, 100)).select("sign", "start", "mass", "p")


@query("condition_bootstrap", f"""with d as (select o_orderkey, month(o_orderdate) as time, o_orderpriority c, o_totalprice x from orders where o_orderpriority in ('1-URGENT', '5-LOW')),
 u as (select *, ('0x' || substr(md5('1|' || round || '|' || o_orderkey), 1, 8))::bigint / 4294967296.0::double u from d, range(0, 101) r(round)), w as (select *, case when round = 0 then 1 else {' + '.join(f'(u >= {p})::int' for p in T.POISSON)} end w from u),
 g as (select time, round, sum(w * x) filter (c = '5-LOW') / nullif(sum(w) filter (c = '5-LOW'), 0) - sum(w * x) filter (c = '1-URGENT') / nullif(sum(w) filter (c = '1-URGENT'), 0) diff from w group by time, round)
 select time, max(diff) filter (round = 0) as diff, quantile_cont(diff, 0.025) filter (round > 0) low, quantile_cont(diff, 0.975) filter (round > 0) high,
 least(1.0, 2 * least(count(*) filter (round > 0 and diff <= 0), count(*) filter (round > 0 and diff >= 0)) / count(diff) filter (round > 0)::double) p from g group by time""", "diff low high p")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("time"), F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("x"))
    return T.bootstrap_difference(o, ["time"], "condition", "x", LEVELS, 100, "o_orderkey")


@query("scr_multiverse", """, e as (select id as event, unit, t et from s where state = 'error'), a as (select event, s.x, s.t - et rel from e join s on e.unit = s.unit and s.t between et - 36000 and et + 36000),
 p as (select lo, hi, th as threshold from (values (0.0, 18000.0), (0.0, 36000.0)) w(lo, hi) cross join (values (10.0), (50.0)) c(th)), g as (select event, lo, hi, threshold, max(x) filter (rel between lo and hi) - coalesce(avg(x) filter (rel < 0), 0) amplitude from a, p group by all)
 select event, lo::double lo, hi::double hi, threshold::double threshold, amplitude, coalesce(amplitude >= threshold, false) present from g""", "amplitude")
def _(spark, d):
    a = J.align_to_events(_anchors(spark, d), samples(spark, d), ["unit"], "et", "t", 36000.0, 36000.0)
    return T.multiverse(a, ["event"], "x", "rel", [(0, 18000), (0, 36000)], [10, 50])


@query("mixed_model_table", ", m as (select avg(h) a, stddev_samp(h) b from s where xm is not null) select id, xm, h, state, (h - a) / b h_z from s, m where xm is not null", "xm h_z")
def _(spark, d):
    return T.mixed_model_table(samples(spark, d).select("id", "xm", "h", "state"), "xm", ["h"], ["state"])


@query("scr_hurdle_table", "select id, (x >= 80)::int response, case when x >= 80 then ln(x) end log_amplitude from s", "log_amplitude")
def _(spark, d):
    return T.hurdle_table(samples(spark, d), ["id"], "x", 80.0)


@query("design_optimization", """, n as (select state, count(*) n, avg(x) u from s group by state), c as (select state, u as utility, n n_done, u + 5.0 / (n + 1) - 2.0 * n / max(n) over () score from n) select *, row_number() over (order by score desc, state) as rank from c""", "utility score")
def _(spark, d):
    s = samples(spark, d)
    return T.design_scores(s.groupBy("state").agg(F.avg("x").alias("utility")), s, "state", "utility", 5.0, 2.0)


# --- schema audits and adapters -------------------------------------------------------


@query("schema_audit_dictionary", """with c as (select 'c_custkey' as column, 'bigint' as type, c_custkey::varchar v from customer union all select 'c_name', 'string', c_name from customer union all select 'c_nationkey', 'int', c_nationkey::varchar from customer
 union all select 'c_acctbal', 'double', c_acctbal::varchar from customer union all select 'c_mktsegment', 'string', c_mktsegment from customer)
 select "column", type, count(*) filter (v is null) n_missing, count(*) filter (v is null) / count(*)::double prop_missing, count(distinct v) + (count(v) < count(*))::int n_unique, '' unit from c group by 1, 2""", "prop_missing")
def _(spark, d):
    return X.dictionary(table(spark, d, "customer"))


@query("active_channels", """, u as (select 'x' channel, x v, true ok from s union all select 'xm', xm, h > 3 from s) select channel, count(*) filter (ok and v is not null) valid, count(*) filter (ok and v <> 0) nonzero, min(v) filter (ok and v <> 0) min, max(v) filter (ok and v <> 0) max, count(*) filter (ok and v <> 0) > 0 active from u group by channel""", "min max")
def _(spark, d):
    return X.active_channels(samples(spark, d).withColumn("v", F.when(F.col("h") > 3, 1).otherwise(0)), {"x": None, "xm": "v"})


@query("rhrv_beat_table", """, b as (select *, lag(x) over (partition by unit order by t, id) was from s where x between 30 and 250) select unit, t, id, x ibi_ms, sum(x) over (partition by unit order by t, id rows unbounded preceding) / 1000 time_s from b where was is null or was <> x""", "t ibi_ms time_s")
def _(spark, d):
    return K.beat_table(samples(spark, d), ["unit"], "x", ORDER, 30.0, 250.0)


@query("eda_bridge", "select unit, t - min(t) over (partition by unit) time_s, case when x > 0 then 1e6 / x end conductance_us from s", "time_s conductance_us")
def _(spark, d):
    return K.eda_bridge(samples(spark, d), ["unit"], "x", "t", "ohm")


@query("event_matrix", "select round((t - 1.7e9) * 60)::bigint sample, 0 previous, dense_rank() over (order by state) code from s")
def _(spark, d):
    return K.event_matrix(samples(spark, d).withColumn("t0", F.col("t") - 1.7e9), "t0", "state", 60.0)


@query("looks_table", "select unit, h, t * 1000 time_ms, state is null track_loss, state = 'view' as view, state = 'click' as click from s", "time_ms")
def _(spark, d):
    return K.looks_table(samples(spark, d), "unit", "h", "t", "state", ["view", "click"])


@query("workflow_overview", """, w as (select unit, state, 100.0 * count(xm) / count(*) p, stddev_samp(xm) sd from s group by unit, state) select count(distinct unit) units, count(*)::bigint windows, count(*) filter (p < 40 or sd is null)::bigint excluded from w""")
def _(spark, d):
    return P.workflow(samples(spark, d), "unit", ["state"], "xm", ORDER, 40.0, 60.0)["overview"]


# --- waveforms of each recording --------------------------------------------------


@query("power_spectrum_bands", """, p as (select unit, x, row_number() over (partition by unit order by t, id) - 1 rn, count(*) over (partition by unit) n from s where x is not null), z as (select *, least(64, n) w, greatest(1, least(64, n) // 2) h from p where n >= 4),
 g as (select z.*, k, rn - k * h j, x - avg(x) over (partition by unit, k) y from z, lateral (select unnest(range(0, (n - w) // h + 1)) k) where rn between k * h and k * h + w - 1),
 d as (select unit, k, w, f, sum(a * y * cos(2 * pi() * f * j / w)) ** 2 + sum(a * y * sin(2 * pi() * f * j / w)) ** 2 q, 4.0 * sum(a * a) e from (select *, 0.5 - 0.5 * cos(2 * pi() * j / (w - 1)) a from g), lateral (select unnest(range(0, w // 2 + 1)) f) group by all),
 m as (select unit, f * 4.0 / w f, avg(q / e) power from d group by all)
 select unit, coalesce(sum(power) filter (f < 0.5), 0) low, coalesce(sum(power) filter (f >= 0.5 and f < 1), 0) mid, coalesce(sum(power) filter (f >= 1 and f < 2), 0) high from m group by unit""", "low mid high")
def _(spark, d):
    return V.band_powers(V.power_spectrum(samples(spark, d), "unit", "x", ORDER, 4.0), "unit", {"low": (0.0, 0.5), "mid": (0.5, 1.0), "high": (1.0, 2.0)})


@query("autoregressive_order")
def _(spark, d):
    return V.ar_spectrum_order(samples(spark, d), "unit", "x", ORDER, 6)


@query("recurrence_quantification", PLACES + BY_UNIT + """, t as (select unit, sum(len) pairs, sum(len) filter (len >= 2) ins from runs group by unit)
 select size.unit, n, case when n >= 4 and tol > 0 then 2 * coalesce(pairs, 0) / (n * (n - 1.0)) end rate, case when n >= 4 and tol > 0 then coalesce(ins, 0) / pairs end determinism from size left join t using (unit)""", "rate determinism")
def _(spark, d):
    return Y.recurrence(samples(spark, d), ["unit"], "x", ORDER)


@query("multiscale_entropy", PLACES + """w as (select v0.*, count(*) over (partition by unit) cnt, scale from v0, (select unnest([1, 2, 3]) scale)),
 x2 as (select unit, scale, v, row_number() over (partition by unit, scale order by box) rn from (select unit, scale, (rn - 1) // scale box, avg(v) v, any_value(cnt) cnt from w group by unit, scale, (rn - 1) // scale having count(*) = any_value(scale)) where cnt >= 10 * scale), """
       + RUNS.format(k="unit, scale", b="b.unit, b.scale", r="unit, scale", on="a.unit = b.unit and a.scale = b.scale", src="x2")
       + """ select distinct w.unit, w.scale, case when a > 0 and b > 0 then -ln(a / b) end entropy from w left join ab using (unit, scale) where cnt >= scale""", "entropy")
def _(spark, d):
    return Y.multiscale_entropy(samples(spark, d), ["unit"], "x", ORDER)


@query("granger_causality")
def _(spark, d):
    return V.granger(samples(spark, d).withColumn("y", F.col("h").cast("double")), "unit", "x", "y", ORDER, 2)


@query("phase_locking")
def _(spark, d):
    return V.phase_locking(samples(spark, d).withColumn("y", F.col("h").cast("double")), "unit", "x", "y", ORDER)


WARPED = "tan(pi() / 8)"
LOW_PASS = f"""with recursive s as (select event_id id, user_id unit, value x, row_number() over (partition by user_id order by ts, event_id) rn from events), c as (select {WARPED} * {WARPED} / (1 + sqrt(2) * {WARPED} + {WARPED} * {WARPED}) b, 2 * ({WARPED} * {WARPED} - 1) / (1 + sqrt(2) * {WARPED} + {WARPED} * {WARPED}) a1, (1 - sqrt(2) * {WARPED} + {WARPED} * {WARPED}) / (1 + sqrt(2) * {WARPED} + {WARPED} * {WARPED}) a2),
 y(unit, rn, id, x1, x2, y1, y2) as (select unit, 0::bigint, null::bigint, x, x, x, x from s where rn = 1 union all
 select s.unit, s.rn, s.id, s.x, y.x1, b * (s.x + 2 * y.x1 + y.x2) - a1 * y.y1 - a2 * y.y2, y.y1 from y join s on s.unit = y.unit and s.rn = y.rn + 1, c)
 select unit, id, y1 filtered from y where rn > 0"""


@query("low_pass_filter", LOW_PASS, "filtered")
def _(spark, d):
    return V.low_pass(samples(spark, d), "unit", "x", ORDER, 0.5, 4.0)


REGRESSOR = """, r as (select a.id, sum(((a.t - e.t) / 172800.0) ** 2 * exp(2 * (1 - (a.t - e.t) / 172800.0))) r from s a join s e on e.unit = a.unit and e.state = 'error' and e.t between a.t - 1209600 and a.t group by a.id), d as (select s.*, coalesce(r, 0) r from s left join r using (id))"""


@query("event_response_regressor", REGRESSOR + " select id, r regressor from d", "regressor")
def _(spark, d):
    return _design(spark, d).select("id", "regressor")


@query("convolution_glm", REGRESSOR + """, f as (select unit, count(*) n, regr_slope(x, r) beta, regr_intercept(x, r) as intercept, regr_r2(x, r) r2, regr_sxx(x, r) sxx, regr_syy(x, r) syy, regr_sxy(x, r) sxy from d group by unit),
 e as (select *, case when n > 2 and sxx > 0 then sqrt(greatest(syy - beta * sxy, 0) / (n - 2) / sxx) end se from f) select unit, n, beta, intercept, r2, se, beta / nullif(se, 0) t from e where sxx > 0""", "beta intercept r2 se t")
def _(spark, d):
    return M.convolution_fit(_design(spark, d), ["unit"], "x", "regressor").where("se is not null")


def _design(spark, d):
    s = samples(spark, d)
    return M.response_regressor(s, s.where("state = 'error'").select("unit", F.col("t").alias("on_t")), ["unit"], "id", "t", "on_t", 1209600.0, 3.0, 86400.0)


# --- further flags, windows and features ------------------------------------------------


@query("mad_artifacts", """, g as (select *, x - lag(x) over (partition by unit order by t, id) st from s), m as (select unit, median(st) c, 1.4826 * mad(st) k from g group by unit) select id, st as step, k > 0 and abs(st - c) > 3 * k needle, coalesce(st = 0, false) flat from g join m using (unit)""", "step")
def _(spark, d):
    return Q.step_artifacts(samples(spark, d), ["unit"], "x", ORDER, 3.0).select("id", "step", "needle", "flat")


@query("mad_artifact_types", """, g as (select *, x - lag(x) over (partition by unit order by t, id) st, row_number() over (partition by unit order by t, id) rn from s), m as (select unit, median(st) c, 1.4826 * mad(st) k from g group by unit), b as (select g.*, c, k, coalesce(abs(st) <= 20, false) still from g join m using (unit)),
 i as (select *, rn - row_number() over (partition by unit, still order by rn) piece from b), f as (select *, still and count(*) over (partition by unit, still, piece) >= 3 flat, coalesce(k > 0 and abs(st - c) > 1.5 * k, false) needle, coalesce(abs(st) > 250, false) wall from i)
 select id, flat or needle or wall mad_artifact, case when needle or (flat and wall) then 'multiple' when flat then 'flatline' when wall then 'wall' else 'none' end mad_artifact_type from f""")
def _(spark, d):
    return Q.mad_artifacts(samples(spark, d), ["unit"], "x", ORDER, 1.5, 20.0, 3, 250.0).select("id", "mad_artifact", "mad_artifact_type")


@query("rate_artifacts_padded", """, g as (select *, row_number() over (partition by unit order by t, id) rn, x not between 5 and 300 or coalesce(100 * abs(x - lag(x) over w) / nullif(lag(x) over w, 0) > 300, false) bad from s window w as (partition by unit order by t, id))
 select id, bad, bool_or(bad) over (partition by unit order by rn rows between 1 preceding and 1 following) padded from g""")
def _(spark, d):
    return Q.rate_artifacts(samples(spark, d), ["unit"], "x", ORDER, 5.0, 300.0, 300.0, 1).select("id", "bad", "padded")


@query("beat_audit", """, g as (select *, lag(x) over w xp, lag(t) over w tp from s window w as (partition by unit order by t, id)) select id, concat_ws(';', case when x not between 20 and 300 then 'range' end, case when t = tp then 'duplicate' end, case when abs(x - xp) / nullif(xp, 0) > 1.5 then 'abrupt' end) reasons from g""")
def _(spark, d):
    return Q.beat_audit(samples(spark, d), ["unit"], "x", "t", ORDER, 20.0, 300.0, 1.5).select("id", "reasons")


@query("gaze_validation_checks", """, g as (select *, t - lag(t) over (partition by unit order by id) dt from s) select unit, count(*) n, count(*) filter (xm is null) missing, count(*) filter (dt = 0) duplicates, count(*) filter (dt < 0) backward, count(*) filter (xm not between 70 and 200) outside,
 count(*) filter (xm is null) = 0 and count(*) filter (dt <= 0) = 0 as passed from g group by unit""")
def _(spark, d):
    return Q.gaze_checks(samples(spark, d), ["unit"], "xm", "t", ["id"], 70.0, 200.0)


@query("sliding_segments", """, v as (select unit, x, round(sum(x) over (partition by unit order by t, id rows unbounded preceding), 6) / 1000 c from s where x > 0), w as (select unit, k, x from v, (select unnest(range((select floor(max(c))::bigint + 1 from v))) k) where c >= k * 1.0 and c < k * 1.0 + 2.0)
 select unit, k as segment, count(*) n, avg(x)::decimal(28, 9) mean, stddev_samp(x)::decimal(28, 9) sd from w group by unit, k having count(*) >= 3""", "mean sd")
def _(spark, d):
    return halves(C.sliding_segments(samples(spark, d), ["unit"], "x", ORDER, 2.0, 1.0, 3), "mean", "sd")


@query("scr_event_peak_choice", """, p as (select *, lag(x) over w a, lead(x) over w b from s window w as (partition by unit order by t, id)), k as (select * from p where x >= 50 and x > a and x >= b), e as (select id as event, unit, t et from s where state = 'error')
 select e.event, count(k.id) n_peaks, arg_max(k.x, (k.x, -k.t)) largest, arg_min(k.x, k.t) as first_peak, arg_max(k.t - et, (k.x, -k.t)) latency from e left join k on e.unit = k.unit and k.t between et and et + 36000 group by e.event""", "largest first_peak latency")
def _(spark, d):
    s = samples(spark, d)
    return J.event_peaks(_anchors(spark, d), E.local_peaks(s, ["unit"], "x", ORDER, 50.0), ["unit"], "event", "et", "t", "x", 36000.0)


@query("scr_recovery_times", """, a as (select e.id as event, e.x x0, s.t - e.t rel, s.x from s e join s on e.unit = s.unit and s.t > e.t and s.t <= e.t + 72000 where e.state = 'error') select event, min(rel) filter (x <= x0 / 2) half_time from a group by event""", "half_time")
def _(spark, d):
    e = samples(spark, d).where("state = 'error'").select("unit", F.col("id").alias("event"), F.col("t").alias("et"), F.col("x").alias("x0"))
    return J.recovery(e, samples(spark, d).select("unit", "t", "x"), ["unit"], "event", "et", "x0", "t", "x", 72000.0)


@query("interval_point_process", """select unit, count(*) n, avg(x) mu, count(*) / sum(1 / x - 1 / m) shape from (select unit, x, avg(x) over (partition by unit) m from s where x > 0) group by unit""", "mu shape")
def _(spark, d):
    return C.inverse_gaussian(samples(spark, d), ["unit"], "x")


@query("trial_regressors", """, e as (select id as event, unit, t et from s where state = 'error') select event, count(s.id) n, avg(s.x) mean_x, stddev_samp(s.x) sd_x from e left join s on e.unit = s.unit and s.t between et - 7200 and et + 7200 group by event""", "mean_x sd_x")
def _(spark, d):
    a = J.event_windows(_anchors(spark, d), samples(spark, d), ["unit"], "event", "et", "t", "x", 7200.0, 7200.0)
    return a.select("event", "n", F.col("mean").alias("mean_x"), F.col("sd").alias("sd_x"))


@query("skin_tone_angle", """with p as (select p_partkey, p_retailprice / 20 l, p_size - 25.0 b from part) select p_partkey, case when b <> 0 then degrees(atan((l - 50) / b)) when l > 50 then 90.0 when l < 50 then -90.0 end ita from p""", "ita")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 20).alias("l"), (F.col("p_size") - 25.0).alias("b"))
    return p.select("p_partkey", S.tone_angle(F.col("l"), F.col("b")).alias("ita"))


@query("admittance_phase", "with l as (select l_orderkey, l_linenumber, l_quantity g, l_tax * 100 b from lineitem) select l_orderkey, l_linenumber, sqrt(g * g + b * b) admittance, atan2(b, g) phase from l", "admittance phase")
def _(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.hypot("l_quantity", F.col("l_tax") * 100).alias("admittance"), F.atan2(F.col("l_tax") * 100, F.col("l_quantity")).alias("phase"))


@query("robust_scaling", "select id, (x - median(x) over w) / nullif(quantile_cont(x, 0.75) over w - quantile_cont(x, 0.25) over w, 0) robust from s window w as (partition by unit)", "robust")
def _(spark, d):
    return S.robust_scale(samples(spark, d), ["unit"], "x").select("id", "robust")


@query("trimmed_recordings", "select id, rel_t from (select id, t - min(t) over (partition by unit) rel_t from s) where rel_t >= 86400 and rel_t < 864000", "rel_t")
def _(spark, d):
    return S.trim(samples(spark, d), ["unit"], "t", 86400.0, 864000.0).select("id", "rel_t")


@query("one_way_anova", """with g as (select o_orderstatus k, o_orderpriority c, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v from orders group by 1, 2), t as (select k, sum(n * m) / sum(n) gm from g group by k)
 select g.k, count(*) - 1 df_between, (sum(n) - count(*))::bigint df_within, sum(n * (m - gm) ** 2) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) f from g join t using (k) group by g.k""", "f")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_orderpriority").alias("c"), F.col("o_totalprice").alias("x"))
    return T.one_way_f(o, ["k"], "c", "x")


@query("kruskal_wallis", """, w as (select unit, state, round(x / 20) v from s), r as (select unit, state, rank() over (partition by unit order by v) + (count(*) over (partition by unit, v) - 1) / 2.0 r from w), g as (select unit, state, count(*) n, sum(r) r from r group by unit, state),
 t as (select unit, sum(c ** 3 - c) t from (select unit, v, count(*)::double c from w group by unit, v) group by unit)
 select unit, sum(n)::bigint n, (12.0 * sum(r * r / n) / (sum(n) * (sum(n) + 1)) - 3 * (sum(n) + 1)) / nullif(1 - any_value(t) / nullif(sum(n) ** 3 - sum(n), 0), 0) h from g join t using (unit) group by unit""", "h")
def _(spark, d):
    return T.kruskal(samples(spark, d).withColumn("v", F.round(F.col("x") / 20)), ["unit"], "state", "v")


@query("icc_agreement", """with l as (select l_returnflag k, l_extendedprice / 1500 a, l_quantity b from lineitem), s as (select k, count(*) n, 2 * var_samp((a + b) / 2) r, var_samp(a - b) / 2 e, count(*) * avg(a - b) ** 2 / 2 c from l group by k)
 select k, n, (r - e) / (r + e + 2 * (c - e) / n) icc from s""", "icc")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_extendedprice") / 1500).alias("a"), F.col("l_quantity").alias("b"))
    return T.icc_agreement(x, ["k"], "a", "b")


@query("aoi_wide_means", "select unit, avg(x) filter (state = 'view') as view, avg(x) filter (state = 'click') as click from s where state in ('view', 'click') group by unit union all select unit, null, null from s group by unit having count(*) filter (state in ('view', 'click')) = 0", "view click")
def _(spark, d):
    return T.wide_means(samples(spark, d), "unit", "state", "x", ["view", "click"])


@query("polygon_areas", """with e as (select * from (values ('tri', 1.0, 900.0, 50.0, 900.0), ('tri', 50.0, 900.0, 25.0, 1500.0), ('tri', 25.0, 1500.0, 1.0, 900.0)) v(aoi, x1, y1, x2, y2))
 select p_partkey, aoi from part join e on (y1 > p_retailprice) <> (y2 > p_retailprice) where p_size < (x2 - x1) * (p_retailprice - y1) / (y2 - y1) + x1 group by p_partkey, aoi having count(*) % 2 = 1""")
def _(spark, d):
    poly = spark.createDataFrame([("tri", [(1.0, 900.0), (50.0, 900.0), (25.0, 1500.0)])], "aoi string, vertices array<struct<x double, y double>>")
    return J.in_polygon(table(spark, d, "part"), poly, "p_partkey", "p_size", "p_retailprice")


# --- summaries, corrections and model tables of recordings -------------------------------


@query("fixations_by_area", """, f as (select unit, case when state = 'view' then null else state end area, t as start, xm duration, h * 3600.0::double onset from s), g as (select unit, area, count(*) fixations, sum(duration) total, avg(duration) mean, median(duration) median, stddev_samp(duration) sd,
 min(duration) shortest, max(duration) longest, min(start) first_start, max(start + duration) last_end, min(start - onset) latency from f where area is not null and duration > 0 group by unit, area) select *, total / sum(total) over (partition by unit) dwell_share from g""", "total mean median sd shortest longest first_start last_end latency dwell_share")
def _(spark, d):
    f = samples(spark, d).select("unit", F.when(F.col("state") != "view", F.col("state")).alias("area"), F.col("t").alias("start"), F.col("xm").alias("duration"), (F.col("h") * 3600.0).alias("onset"))
    return M.fixations_by_area(f, ["unit"], "area", "start", "duration", "onset")


@query("tracking_summary", """select unit, count(*) n, avg((coalesce(xm > 0, false))::int) pupil_ratio, avg((x between 0 and 100 and h between 6 and 18)::int) gaze_ratio, avg((coalesce(xm > 0, false) and x between 0 and 100 and h between 6 and 18)::int) tracking_ratio,
 count(*) filter (not (coalesce(xm > 0, false) and x between 0 and 100 and h between 6 and 18)) n_invalid from s group by unit""", "pupil_ratio gaze_ratio tracking_ratio")
def _(spark, d):
    return M.tracking(samples(spark, d), ["unit"], ["xm"], "x", "h", (0.0, 100.0, 6.0, 18.0))


@query("clock_mapped_times", """with p as (select o_custkey % 50 k, date_diff('day', date '1990-01-01', o_orderdate)::double r, date_diff('day', date '1990-01-01', l_shipdate)::double g from orders join lineitem on o_orderkey = l_orderkey), f as (select k, regr_slope(r, g) a, regr_intercept(r, g) b from p where k < 40 group by k)
 select l_orderkey, l_linenumber, f.b + f.a * date_diff('day', date '1990-01-01', l_shipdate) reference_t from lineitem join orders on o_orderkey = l_orderkey left join f on f.k = o_custkey % 50""", "reference_t")
def _(spark, d):
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date")).cast("double")
    p = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", (F.col("o_custkey") % 50).alias("k"), day("o_orderdate").alias("r"), day("l_shipdate").alias("g"))
    return M.map_clock(p, J.clock_fit(p.where("k < 40"), ["k"], "r", "g"), ["k"], "g").select("l_orderkey", "l_linenumber", "reference_t")


@query("multimodal_model_table", """, w as (select unit, state, count(xm) n, avg(xm) mean from s where state <> 'click' group by unit, state), e as (select unit, state, avg(h) mean, count(*) looks from s where state <> 'view' group by unit, state)
 select coalesce(w.unit, e.unit) unit, coalesce(w.state, e.state) state, w.n, w.mean, e.mean mean_eye, e.looks, case when w.unit is null then 'eye_tracking_only' when e.unit is null then 'biometrics_only' else 'both' end source from w full join e on w.unit = e.unit and w.state = e.state""", "mean mean_eye")
def _(spark, d):
    s = samples(spark, d)
    w = s.where("state <> 'click'").groupBy("unit", "state").agg(F.count("xm").alias("n"), F.avg("xm").alias("mean"))
    e = s.where("state <> 'view'").groupBy("unit", "state").agg(F.avg("h").alias("mean"), F.count("*").alias("looks"))
    return M.multimodal_table(w, e, ["unit", "state"], outer=True)


@query("mixed_effects_table", """, d as (select id, xm - x / 2 y, nullif(trim(state), '') state, h, t / 1e6 tm from s where xm is not null), m as (select avg(h) a, stddev_samp(h) b, avg(tm) c, stddev_samp(tm) e from d) select id, y, state, (h - a) / b h_z, (tm - c) / e tm_z from d, m""", "y h_z tm_z")
def _(spark, d):
    s = samples(spark, d).withColumn("half", F.col("x") / 2).withColumn("tm", F.col("t") / 1e6)
    return M.mixed_effects_table(s, "xm", "half", ["state"], ["h", "tm"], ["id"])


@query("beat_corrections", """, g as (select *, coalesce(x not between 20 and 150, false) f from s), c as (select *, quantile_cont(case when not f then x end, 0.5) over (partition by unit order by t, id rows between 2 preceding and 2 following) l, quantile_cont(case when not f then x end, 0.5) over (partition by unit) m from g)
 select id, case when f then coalesce(l, m) else x end corrected, case when not f then 'kept' when l is not null then 'local_median' when m is not null then 'group_median' else 'no_reference' end note from c""", "corrected")
def _(spark, d):
    return M.correct_beats(samples(spark, d), ["unit"], "x", ~F.col("x").between(20, 150), ORDER, 2).select("id", "corrected", "note")


@query("ibi_windows", """, g as (select *, coalesce(xm between 65 and 220, false) and coalesce(abs(xm - lag(xm) over (partition by unit order by t, id)) <= 60, true) ok from s)
 select unit, count(*) n_rows, count(xm) n_ibi, count(*) filter (ok) n_valid, count(*) filter (not ok) n_excluded, sum(xm) filter (ok) / 1000 duration_s, avg(xm) filter (ok) mean_ibi, stddev_samp(xm) filter (ok) sdnn, count(*) filter (ok) / count(*)::double valid_rate,
 case when count(*) filter (ok) >= 5 then 'sufficient' else 'insufficient' end status from g group by unit""", "duration_s mean_ibi sdnn valid_rate")
def _(spark, d):
    return M.ibi_windows(samples(spark, d), ["unit"], "xm", ORDER, 65.0, 220.0, 60.0, 5)


@query("conductance_units", """, q as (select state, count(*) n, count(xm) n_finite, quantile_cont(xm, 0.01) q01, median(xm) median, quantile_cont(xm, 0.75) q75, quantile_cont(xm, 0.99) q99 from s group by state)
 select *, case when median > 1000 or q75 > 1000 then 'resistance' when median > 0 and median <= 100 and q99 <= 500 then 'conductance' when median > 100 and median <= 1000 then 'scaled' else 'ambiguous' end likely_unit from q""", "q01 median q75 q99")
def _(spark, d):
    return M.conductance_units(samples(spark, d), ["state"], "xm", "GSR")


@query("timebase_audit", """, g as (select unit, t - lag(t) over (partition by unit order by id) d from s), m as (select unit, median(d) m from g where d > 0 group by unit)
 select g.unit, count(*) n, any_value(m) median_step, count(*) filter (d = 0) repeats, count(*) filter (d < 0) backward, count(*) filter (d > 3 * m) gaps, max(d) longest_step,
 case when any_value(m) is null or count(*) filter (d < 0) > 0 then 'fail' when count(*) filter (d = 0) > 0 or count(*) filter (d > 3 * m) > 0 then 'warn' else 'pass' end status from g left join m using (unit) group by g.unit""", "median_step longest_step")
def _(spark, d):
    return M.timebase(samples(spark, d), ["unit"], "t", ["id"])


def _lag_sql(a: str, b: str) -> str:
    return f"""select unit, '{a}' signal_1, '{b}' signal_2, arg_max(lag, (round(abs(r), 9), -abs(lag), lag)) best_lag, max(abs(r)) best_r from
 (select a.unit, l.lag, corr(a.{a}, b.{b}) r from g a cross join l join g b on b.unit = a.unit and b.rn = a.rn + l.lag group by a.unit, l.lag having count(case when a.{a} is not null then b.{b} end) >= 5) group by unit"""


@query("signal_lag_matrix", ", g as (select unit, x, xm, h::double hd, row_number() over (partition by unit order by t, id) rn from s), l as (select unnest(range(-2, 3))::int lag) " + " union all ".join(_lag_sql(*p) for p in (("x", "xm"), ("x", "hd"), ("xm", "hd"))), "best_r")
def _(spark, d):
    return M.lag_matrix(samples(spark, d).withColumn("hd", F.col("h").cast("double")), ["unit"], ["x", "xm", "hd"], ORDER, 2)
