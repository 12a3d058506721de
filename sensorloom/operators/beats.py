"""Peaks, skin-conductance responses, pulse beats and beat shapes of long recordings.

Samples get their places by ranges; neighbours are looked at in blocks of
``ROWS`` samples with copied borders, and whatever depends on the choice of other
peaks is settled within short stretches of peaks that nothing outside can touch.
No step holds a recording in one task; only tables of runs and peaks are put in
order by recording.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.blocks import BLOCK, HOME, carried, home, in_blocks, near, within
from ..functions.core import BEFORE, correlation, median, ordered, whole
from ..functions.ranges import kept, matched, running

ROWS = 1024
#: The thresholds tried for beats, in standard deviations above the moving average.
OFFSETS = [k / 20 for k in range(-5, 26)]


def signal(df: DataFrame, keys, x: str, t: str, order) -> DataFrame:
    """(keys, rn, n, v, t): the valid samples with their place from 0 and the recording's size."""
    d = df.select(*dict.fromkeys([*keys, *order]), F.col(x).cast("double").alias("_x"), F.col(t).cast("double").alias("_t")).where("_x is not null")
    return running(d, keys, order, rn=F.lit(1).cast("long")).select(*keys, F.col("rn_before").alias("rn"), F.col("rn_total").alias("n"), F.col("_x").alias("v"), F.col("_t").alias("t"))


def _neighbours(s: DataFrame, keys) -> DataFrame:
    """Adds the sample before (``before``) and after (``after``)."""
    one = lambda k: F.first("v").over(near(keys, "rn", k, k))
    return home(in_blocks(s, "rn", ROWS, 1).withColumn("before", one(-1)).withColumn("after", one(1)))


IS_PEAK = "v > before and v >= after"


def thinned(peaks: DataFrame, keys, distance: int) -> DataFrame:
    """Peaks of which taller ones (of equals the first) suppress those fewer than ``distance`` places away.

    A peak that is the tallest of its surroundings stays and clears them. What is
    left falls into stretches at least ``distance`` apart; each is settled on its
    own, tallest first. A stretch has no such tallest peak and so is a slope
    of closely set peaks; its cost is quadratic in their number.
    """
    if distance <= 1:
        return peaks
    reach, names = float(distance - 1), peaks.columns
    d = in_blocks(peaks, "rn", ROWS, 2 * reach).withColumn("_at", F.col("rn").cast("double")).withColumn("_rank", F.struct("v", (-F.col("rn")).alias("first")))
    d = d.withColumn("_sure", F.col("_rank") == within("max(_rank)", keys, "_at", reach)).withColumn("_cleared", within("max(_sure)", keys, "_at", reach))
    d = kept(home(d).where("_sure or not _cleared").select(*names, "_sure"))
    rest = in_blocks(d.where("not _sure").drop("_sure"), "rn", ROWS, distance)
    rest = rest.withColumn("_new", F.coalesce(F.col("rn") - F.first("rn").over(near(keys, "rn", -1, -1)) >= distance, F.lit(True)).cast("int"))
    rest = running(home(rest), keys, ["rn"], stretch=F.col("_new")).withColumn("_stretch", F.col("stretch_before") + F.col("_new"))
    every = F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("_v"), "rn", F.struct(*names).alias("_all"))))
    g = rest.groupBy(*keys, "_stretch").agg(every.alias("_p"))
    free = lambda out, p: ~F.exists(out, lambda q: F.abs(q["rn"] - p["rn"]) < distance)
    chosen = F.aggregate("_p", F.slice("_p", F.lit(1), F.lit(0)), lambda out, p: F.when(free(out, p), F.concat(out, F.array(p))).otherwise(out))
    return d.where("_sure").select(*names).unionByName(g.select(F.explode(chosen).alias("_c")).select("_c._all.*"))


def _first_at_most(peaks: DataFrame, samples: DataFrame, keys, target: str, name: str) -> DataFrame:
    """Adds ``name``, (rn, v, t) of the first sample behind each peak that is at most ``target``, or NULL.

    A peak looks into its own block first. If nothing there is low enough, but a later
    block is, it looks at the least values of the next 1, 2, 4 ... blocks until one is.
    """
    s = samples.withColumn(BLOCK, F.floor(F.col("rn") / ROWS).cast("long"))
    b = s.groupBy(*keys, BLOCK).agg(F.sort_array(F.collect_list(F.struct("rn", "v", "t"))).alias("_s"), F.min("v").alias("_low"))
    b = kept(b.withColumn("_later", F.min("_low").over(ordered(keys, [BLOCK], 1, Window.unboundedFollowing))))
    hit = F.get(F.filter("_s", lambda q: (q["rn"] > F.col("rn")) & (q["v"] <= F.col(target))), 0)
    look = lambda p: matched(p, b, [*keys, BLOCK], "left").withColumn(name, hit).drop("_s", "_low")
    found = kept(look(peaks.withColumn(BLOCK, F.floor(F.col("rn") / ROWS).cast("long"))))
    open_ = F.col(name).isNull() & F.coalesce(F.col("_later") <= F.col(target), F.lit(False))
    done, pending = found.where(~open_).drop(BLOCK, "_later"), found.where(open_).drop("_later", name)
    start, span = 1, 1
    while not pending.isEmpty():
        tries = pending.select(*keys, "rn", target, F.explode(F.sequence(F.col(BLOCK) + start, F.col(BLOCK) + (start + span - 1))).alias(BLOCK))
        at = matched(tries, b.select(*keys, BLOCK, "_low"), [*keys, BLOCK]).where(F.col("_low") <= F.col(target)).groupBy(*keys, "rn").agg(F.min(BLOCK).alias("_found"))
        pending = kept(matched(pending, at, [*keys, "rn"], "left"))
        settled = pending.where("_found is not null").withColumn(BLOCK, F.col("_found")).drop("_found")
        done = done.unionByName(look(settled).drop(BLOCK, "_later"))
        pending, start, span = pending.where("_found is null").drop("_found"), start + span, 2 * span
    return done


def scr_peaks(df: DataFrame, keys, x: str, t: str, order, height: float | None, distance: int, amplitude: float, recovery: float = 0.5, flat_rises: bool = False) -> DataFrame:
    """(keys, onset, peak, amplitude, rise_time, recovery, status): responses of at least ``amplitude``.

    Peaks of at least ``height`` are thinned by ``distance``. A response begins at the foot
    of the rise to its peak (with ``flat_rises``, equal neighbours belong to the rise) and
    has recovered at the first later sample that has lost the share ``recovery`` of the
    amplitude; its time after the peak is NULL, and the status
    ``detected_incomplete_recovery``, if there is none. Missing samples are left out.
    """
    s = signal(df, keys, x, t, order)
    rise = F.col("v") >= F.col("before") if flat_rises else F.col("v") > F.col("before")
    d = carried(_neighbours(s, keys), keys, "rn", F.when(~F.coalesce(rise, F.lit(False)), F.struct("t", "v")), ROWS, "_foot")
    d = d.where(IS_PEAK) if height is None else d.where(F.expr(IS_PEAK) & (F.col("v") >= height))
    d = thinned(d.select(*keys, "rn", "v", "t", "_foot"), keys, distance).withColumn("amplitude", F.col("v") - F.col("_foot.v")).where(F.col("amplitude") >= amplitude)
    d = _first_at_most(d.withColumn("_target", F.col("v") - recovery * F.col("amplitude")), s, keys, "_target", "_back")
    return d.select(*keys, F.col("_foot.t").alias("onset"), F.col("t").alias("peak"), "amplitude", (F.col("t") - F.col("_foot.t")).alias("rise_time"), (F.col("_back.t") - F.col("t")).alias("recovery"),
                    F.when(F.col("_back").isNull(), "detected_incomplete_recovery").otherwise("detected").alias("status"))


def _runs(keys, rows: int):
    """Runs of samples above each level, with their tallest sample; blocks of ``rows`` samples come one after the other, a run ends with its batch."""

    def run(batches):
        for batch in batches:
            above, rn, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_levels", "rn", "v"))
            if not batch.num_rows or not above.max():
                continue
            size, opens = len(rn), rn % rows == 0
            rank = np.unique(v, return_inverse=True)[1] * size + np.arange(size)[::-1]  # by height, of equals the first
            found = []
            for level in range(above.max()):
                at = np.flatnonzero(above > level)
                start = np.flatnonzero(np.append(True, (np.diff(at) > 1) | opens[at[1:]]))
                top = size - 1 - np.maximum.reduceat(rank[at], start) % size
                found.append((np.full(len(start), level, "int32"), rn[at[start]], rn[at[np.append(start[1:], len(at)) - 1]], top))
            level, lo, hi, top = map(np.concatenate, zip(*found))
            tops = [batch.column(c).take(pa.array(top)) for c in (*keys, "rn", "v", "t")]
            yield pa.RecordBatch.from_arrays([*tops, pa.array(level), pa.array(lo), pa.array(hi)], names=[*keys, "rn", "v", "t", "level", "lo", "hi"])

    return run


def _regions(d: DataFrame, keys) -> DataFrame:
    """(keys, level, rn, v, t, lo): the tallest sample of each run of samples above a level; ``lo`` puts them in order.

    ``d`` holds the blocks of ``ROWS`` samples, with the number of levels that each
    sample is above (``_levels``; level k for those above more than k). Samples are
    not multiplied by their levels: Python goes through one Arrow batch at a time and
    only runs leave it. Runs cut by the end of a block or batch touch and are joined.
    """
    d = d.select(*keys, BLOCK, "rn", "v", "t", F.col("_levels").cast("int").alias("_levels")).sortWithinPartitions(*keys, BLOCK, "rn")
    schema = StructType([*[d.schema[c] for c in (*keys, "rn", "v", "t")], StructField("level", IntegerType()), StructField("lo", LongType()), StructField("hi", LongType())])
    w = ordered([*keys, "level"], ["lo"])
    runs = d.mapInArrow(_runs(keys, ROWS), schema).withColumn("_new", F.coalesce(F.col("lo") > F.lag("hi").over(w) + 1, F.lit(True)))
    runs = runs.withColumn("_one", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(BEFORE, 0))).withColumn("_last", F.coalesce(F.lead("_new").over(w), F.lit(True)))
    # later runs have greater numbers, so the greatest so far is the tallest of the run itself
    top = F.max(F.struct("_one", "v", (-F.col("rn")).alias("r"), "t")).over(w.rowsBetween(BEFORE, 0))
    runs = runs.select(*keys, "level", "lo", "_last", top.alias("_top")).where("_last")
    return runs.select(*keys, "level", (-F.col("_top.r")).alias("rn"), "_top.v", "_top.t", "lo")


def _taken(names, distance: int):
    """The peaks of ``_spaced``; they come recording by recording in order, and the last one taken waits for the next batch."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            rank = np.unique(batch.column("v").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            kept, at, top = [], 0, 0
            for k, (new, rn, height) in enumerate(zip(batch.column("_new").to_pylist(), batch.column("rn").to_pylist(), rank.tolist())):
                if not kept or new or rn - at >= distance:
                    kept.append(k)
                elif height > top:
                    kept[-1] = k
                else:
                    continue
                at, top = rn, height
            out = batch.take(pa.array(kept))
            held = out.slice(len(kept) - 1)
            yield out.slice(0, len(kept) - 1).select(names)
        if held is not None:
            yield held.select(names)

    return run


def _spaced(peaks: DataFrame, keys, distance: int) -> DataFrame:
    """(keys, rn, v, t): peaks in order (``lo``), one that comes fewer than ``distance`` places behind the last kept one replacing it if it is taller.

    They stream through Python in Arrow batches; of a recording only the last kept peak is held.
    """
    names = [*keys, "rn", "v", "t"]
    if distance <= 1:
        return peaks.select(*names)
    d = peaks.withColumn("_new", F.lag("rn").over(ordered(keys, ["lo"])).isNull()).sortWithinPartitions(*keys, "lo")
    return d.mapInArrow(_taken(names, distance), StructType([d.schema[c] for c in names]))


def beats(df: DataFrame, keys, x: str, t: str, order, rate: float, bpm: tuple[float, float] = (40.0, 180.0), average: float = 0.75, offsets=None) -> DataFrame:
    """(keys, beat_time, beat_value, interval, offset): pulse beats above a moving average.

    The average spans an odd number of samples, at least 3, of twice ``average``
    seconds; where it does not fit, and in shorter recordings, the recording's mean stands for it.
    Each of ``offsets``, in standard deviations of the recording, is added to it; the tallest sample of
    each run above is a beat, spaced by four fifths of the shortest interval of ``bpm``. Of the
    offsets that find three beats or more at a rate within ``bpm`` the one with the
    least spread of successive interval differences wins, ties going to the lower offset; if none
    does, 0 is taken. Missing samples are left out. ``interval`` is in the unit of ``t`` (seconds).
    """
    offsets = sorted({0.0, *(OFFSETS if offsets is None else offsets)})
    span = max(3, round(2 * average * rate))
    half, least = span // 2, max(1, int(rate * 60 / bpm[1] * 0.8))
    s = signal(df, keys, x, t, order)
    about = s.groupBy(*keys).agg(F.avg("v").alias("_mean"), F.stddev_samp("v").alias("_sd"), ((F.max("t") - F.min("t")) / 60).alias("_minutes"))
    w = near(keys, "rn", -half, half)
    d = in_blocks(matched(s, about, keys), "rn", ROWS, half).withColumn("_avg", F.when(F.count("*").over(w) == 2 * half + 1, F.avg("v").over(w))).where(HOME)
    base, sd = F.coalesce("_avg", "_mean"), F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    d = d.withColumn("_over", F.round((F.col("v") - base) / sd, 9))  # a sample at its average is not above it, however the average was summed
    d = d.withColumn("_levels", sum((F.col("_over") > o).cast("int") for o in offsets))  # levels are places in the offsets: a double as key would be normalised at every step and shuffled anew
    by = [*keys, "level"]
    b = kept(_spaced(_regions(d, keys), by, least))
    w = ordered(by, ["rn"])
    interval = F.col("t") - F.lag("t").over(w)
    timed = b.withColumn("interval", interval).withColumn("_change", F.col("interval") - F.lag("interval").over(w))
    fit = timed.groupBy(*by).agg(F.count("*").alias("_n"), F.when(F.count("_change") >= 2, F.stddev_samp("_change")).alias("_spread"))
    fit = matched(fit, about, keys).where((F.col("_n") >= 3) & F.try_divide(F.col("_n"), F.col("_minutes")).between(*bpm))
    spread = F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(float("inf"))
    best = fit.groupBy(*keys).agg(F.min(F.struct(spread.alias("s"), "level"))["level"].alias("_best"))
    out = matched(b, best, keys, "left").where(F.col("level") == F.coalesce("_best", F.lit(offsets.index(0.0)))).withColumn("interval", interval)
    return out.select(*keys, F.col("t").alias("beat_time"), F.col("v").alias("beat_value"), "interval", F.get(F.array(*[F.lit(o) for o in offsets]), F.col("level")).alias("offset"))


def rejected(beat_table: DataFrame, keys, t: str = "beat_time", share: float = 0.3, least_ms: float = 300.0) -> DataFrame:
    """Adds ``rr_ms``, the interval behind the beat before, and ``accepted``: within the larger of ``share`` of the mean interval and ``least_ms`` of that mean.

    Recordings of under three beats are accepted whole, without intervals. Beats without a time come last and have none.
    """
    every = F.count("*").over(whole(keys)) >= 3
    step = F.when(every, (F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(F.col(t).asc_nulls_last()))) * 1000)
    d = beat_table.withColumn("rr_ms", step).withColumn("_m", F.avg("rr_ms").over(whole(keys)))
    return d.withColumn("accepted", F.coalesce(F.abs(F.col("rr_ms") - F.col("_m")) <= F.greatest(share * F.col("_m"), F.lit(least_ms)), F.lit(True))).drop("_m")


def measures(beat_table: DataFrame, keys, t: str = "beat_time") -> DataFrame:
    """Rate and interval measures (ms) of the accepted beats of each recording; all but the count are NULL for under three beats.

    Recordings without an accepted beat keep a row. A column ``accepted`` is used if there is one.
    """
    ok = F.col(t).isNotNull() & F.col("accepted") if "accepted" in beat_table.columns else F.col(t).isNotNull()
    by = [*keys, "_ok"]  # beats that do not count are a group of their own, so that the beats are made and read once
    w = ordered(by, ["_t"])
    d = beat_table.select(*keys, F.coalesce(ok, F.lit(False)).alias("_ok"), F.col(t).cast("double").alias("_t"))
    d = d.withColumn("_rr", (F.col("_t") - F.lag("_t").over(w)) * 1000).withColumn("_d", F.col("_rr") - F.lag("_rr").over(w)).withColumn("_mid", median("_rr").over(whole(by)))
    d = d.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("_t", "_rr", "_d")})
    share = lambda ms: F.avg((F.abs("_d") > ms).cast("double"))
    n = F.count("_t")
    cells = {"bpm": F.try_divide(60.0 * n, F.max("_t") - F.min("_t")), "ibi_ms": F.avg("_rr"), "sdnn_ms": F.stddev_samp("_rr"), "sdsd_ms": F.stddev_samp("_d"), "rmssd_ms": F.sqrt(F.avg(F.col("_d") * F.col("_d"))),
             "pnn20": share(20), "pnn50": share(50), "mad_rr_ms": 1.4826 * median(F.abs(F.col("_rr") - F.col("_mid")))}
    return d.groupBy(*keys).agg(n.alias("n_peaks"), *[F.when(n >= 3, e).alias(c) for c, e in cells.items()])


def templates(df: DataFrame, keys, x: str, order, distance: int, half: int) -> DataFrame:
    """(keys, beat, place, v, template): the samples around each beat with the median of all beats at that place; beats too near to an end are left out."""
    s = signal(df, keys, x, order[0], order)
    p = thinned(_neighbours(s, keys).where(IS_PEAK).select(*keys, "rn", "n", "v"), keys, distance).where((F.col("rn") >= half) & (F.col("rn") < F.col("n") - half))
    p = p.select(*keys, F.col("rn").alias("beat"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("place"))
    d = kept(matched(p.withColumn("rn", F.col("beat") + F.col("place")), s.select(*keys, "rn", "v"), [*keys, "rn"]).select(*keys, "beat", "place", "v"))
    return matched(d, d.groupBy(*keys, "place").agg(median("v").alias("template")), [*keys, "place"])


def template_similarity(df: DataFrame, keys, x: str, order, distance: int, half: int) -> DataFrame:
    """(keys, beats, mean_r, min_r): correlation of each beat with the median beat, 0 where one of them is flat; NULL for under two beats."""
    r = templates(df, keys, x, order, distance, half).groupBy(*keys, "beat").agg(F.coalesce(correlation("v", "template"), F.lit(0.0)).alias("_r"))
    r = r.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_r").alias("_mean"), F.min("_r").alias("_min"))
    some = F.col("_n") >= 2
    return matched(df.select(*keys).distinct(), r, keys, "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("beats"), F.when(some, F.col("_mean")).alias("mean_r"), F.when(some, F.col("_min")).alias("min_r"))
