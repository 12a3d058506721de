"""Device exports: delimited files and folders, column roles, schema audits, data dictionary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.core import median, union_all

MISSING = ("", "NA", "NaN")
# Column aliases by role, lower-case, without separators.
ROLES = {
    "time": ("time", "times", "timesec", "timestamp", "timestamps", "timestampsec", "recordingtime", "recordingtimes"),
    "time_ms": ("timems", "timestampms", "recordingtimems"),
    "time_tick": ("timetick", "timeticks", "tick", "ticks"),
    "trial_time": ("trialtime", "trialtimes", "timeintrial"),
    "media_time": ("mediatime", "stimulustime", "stimulustimes"),
    "counter": ("cnt", "counter", "count", "sample", "sampleindex", "samplenumber", "sampleno", "sampleid", "samplecounter"),
    "participant": ("user", "userid", "participant", "participantid", "subject", "subjectid", "id"),
    "file": ("userfile", "file", "filename", "sourcefile"),
    "stimulus": ("mediaid", "stimulusid", "medianame", "stimulus", "stimulusname", "image", "video"),
    "trial": ("trial", "trialid", "trialnumber"),
    "condition": ("condition", "group", "experimentalcondition"),
    "gsr": ("gsr", "gsrus", "gsrmicrosiemens", "eda", "edaus", "edamicrosiemens", "electrodermalactivity", "skinconductance", "skinconductanceus", "skinresponse", "conductance", "conductanceus"),
    "gsr_ohms": ("gsrohm", "gsrohms", "edaohm", "edaohms", "resistance", "resistanceohm", "resistanceohms", "skinresistance", "skinresistanceohms"),
    "gsr_validity": ("gsrv",),
    "hr": ("hr", "heartrate", "bpm", "pulse", "pulserate"),
    "hr_validity": ("hrv", "hrvalid", "hrvalidity", "heartratevalid", "heartratevalidity"),
    "pulse": ("hrp", "ppg", "bvp"),
    "ibi": ("ibi", "rr", "rrinterval", "rrintervals", "interbeatinterval", "interbeatintervalms", "rrms"),
    "dial": ("engagement", "engagementdial", "dial", "dialvalue", "engagementvalue", "rotary", "selfreportedengagement"),
    "marker": ("ttl", "ttlvalue", "ttlsignal", "ttlmarker", "eventmarker", "marker", "trigger", "digitalmarker"),
    "event": ("event", "eventname", "eventlabel"),
    "pupil_left": ("lpmm", "lpd", "pupilleft"),
    "pupil_right": ("rpmm", "rpd", "pupilright"),
    "gaze_x": ("fpogx", "bpogx", "gazex"),
    "gaze_y": ("fpogy", "bpogy", "gazey"),
    "aoi": ("aoi",),
}
# Names of the columns of event logs, the preferred ones first.
EVENT_TIMES = ("event_time", "time_s", "time", "timestamp", "onset", "onset_time", "trial_onset", "stimulus_onset")
EVENT_LABELS = ("event_label", "label", "event", "condition", "type", "stimulus")
EVENT_IDS = ("event_id", "trial_id", "trial", "id")
CLOCKS = ("time", "time_ms", "time_tick", "counter")


def clean_name(name: str) -> str:
    """Micro signs become u, runs of other characters one underscore."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name.replace("µ", "u").replace("μ", "u")).strip("_")


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get the suffix _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def role_of(name: str) -> str | None:
    key = re.sub(r"[^a-z0-9]", "", clean_name(name).lower())
    if re.fullmatch(r"ttl\d", key):
        return "marker"
    if key == "ttlv":
        return "marker_validity"
    return next((r for r, names in ROLES.items() if key in names), None)


def standard_names(df: DataFrame, to_roles: bool = False) -> DataFrame:
    """Cleaned column names, or role names where a role is known; a change of schema only."""
    names = [(role_of(c) if to_roles else None) or clean_name(c) for c in df.columns]
    return df.toDF(*unique_names(names))


def delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon and tab in the first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(",;\t", key=line.count)


def read_export(spark: SparkSession, path: str, missing=MISSING, sep: str | None = None) -> DataFrame:
    """One delimited export as strings with missing tokens as NULL; unnamed columns without values go."""
    df = spark.read.csv(path, header=True, sep=sep or delimiter(spark, path), encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in df.columns])
    unnamed = [c for c in df.columns if re.fullmatch(r"_c\d+|Unnamed.*", c)]
    if unnamed:
        counts = df.agg(*[F.count(c).alias(c) for c in unnamed]).first()
        df = df.drop(*[c for c in unnamed if not counts[c]])
    return df


def read_folder(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """All exports of a folder under one schema, with each row's file and the participant in its name.

    Files are listed and grouped by header through Spark's readers, so any store works.
    """
    files = [r[0] for r in spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name()).distinct().collect()]
    frames = []
    for f in sorted(files):  # a recording session's files
        name = f.rsplit("/", 1)[-1]
        frames.append(read_export(spark, f).withColumn("source_file", F.lit(name)).withColumn("source_participant", F.lit(re.split(r"[_.]", name)[0])))
    return union_all(frames)


def numeric(df: DataFrame, columns) -> DataFrame:
    """Columns as double; text that is no finite number is NULL."""
    for c in columns:
        v = F.expr(f"try_cast(`{c}` as double)")
        df = df.withColumn(c, F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))
    return df


def schema_audit(df: DataFrame) -> DataFrame:
    """Per column: type, role, non-missing and distinct counts and a status; one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias("k_" + c) for c in df.columns], *[F.count_distinct(c).alias("u_" + c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(role_of(c)).alias("role"), F.col("k_" + c).alias("n_present"), F.col("u_" + c).alias("n_unique"), F.col("n").alias("n_rows")) for c, t in df.dtypes])
    status = F.when(F.col("n_present") == 0, "empty").when(F.col("n_unique") == 1, "constant").when(F.col("n_present") < F.col("n_rows"), "partial").otherwise("complete")
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("status", status)


def dictionary(df: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Data dictionary: type, missing share and distinct values (a missing value counts as one)."""
    a = schema_audit(df)
    unit = F.coalesce(*[F.when(F.col("column") == c, F.lit(u)) for c, u in (units or {}).items()], F.lit(""))
    return a.select("column", "type", (F.col("n_rows") - F.col("n_present")).alias("n_missing"), ((F.col("n_rows") - F.col("n_present")) / F.col("n_rows")).alias("prop_missing"),
                    (F.col("n_unique") + (F.col("n_present") < F.col("n_rows")).cast("int")).alias("n_unique"), unit.alias("unit"))


def active_channels(df: DataFrame, channels: dict[str, str | None]) -> DataFrame:
    """Per channel: valid and nonzero rows, extremes of the usable ones, and whether it is active. Values name validity columns."""
    cells = []
    for c, validity in channels.items():
        ok = F.col(c).isNotNull() & (F.coalesce(F.col(validity) > 0, F.lit(False)) if validity else F.lit(True))
        use = F.when(ok & (F.col(c) != 0), F.col(c))
        cells += [F.count_if(ok).alias("v_" + c), F.count(use).alias("z_" + c), F.min(use).cast("double").alias("l_" + c), F.max(use).cast("double").alias("h_" + c)]
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col("v_" + c).alias("valid"), F.col("z_" + c).alias("nonzero"), F.col("l_" + c).alias("min"), F.col("h_" + c).alias("max")) for c in channels])
    return df.agg(*cells).select(F.explode(rows).alias("r")).select("r.*").withColumn("active", F.col("nonzero") > 0)


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required roles or names that the table lacks."""
    have = {c.lower() for c in df.columns} | {role_of(c) for c in df.columns}
    return [r for r in required if r.lower() not in have and r not in have]


def _named(df: DataFrame, names) -> str | None:
    lower = {c.lower(): c for c in df.columns}
    return next((lower[n] for n in names if n in lower), None)


def read_event_log(spark: SparkSession, path: str, time: str | None = None, label: str | None = None, event_id: str | None = None) -> DataFrame:
    """An event log with event_id, event_time (seconds) and event_label beside its own columns; rows without a time go.

    Times whose median step in file order is over 5 are milliseconds. Without an
    id column, rows are named in the order of time and label.
    """
    df = read_export(spark, path)
    time, label, event_id = time or _named(df, EVENT_TIMES), label or _named(df, EVENT_LABELS), event_id or _named(df, EVENT_IDS)
    if time is None:
        raise ValueError("the log has no time column")
    text = F.col(f"`{label}`") if label else F.lit(None).cast("string")
    d = df.withColumn("_line", F.monotonically_increasing_id()).withColumn("_time", F.expr(f"try_cast(`{time}` as double)")).where("_time is not null").withColumn("_label", text)
    step = d.withColumn("_d", F.col("_time") - F.lag("_time").over(Window.orderBy("_line"))).where("_d > 0")
    unit = 1000.0 if (step.agg(median("_d")).first()[0] or 0) > 5 else 1.0
    name = F.col(f"`{event_id}`") if event_id else F.row_number().over(Window.orderBy("_time", "_label")).cast("string")  # a log is one session's events
    own = [c for c in df.columns if c not in ("event_id", "event_time", "event_label")]
    return d.select(name.alias("event_id"), (F.col("_time") / unit).alias("event_time"), F.coalesce("_label", F.concat(F.lit("event_"), name)).alias("event_label"), *[F.col(f"`{c}`") for c in own])


def read_session(spark: SparkSession, path: str, session: str | None = None) -> dict[str, DataFrame]:
    """The exports of a session folder by file name; ``session`` keeps the files that begin with it."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{session or ''}*.csv").load(path).select("path", "length")  # names only: contents are not read
    out = {r.path.rsplit("/", 1)[-1]: read_export(spark, r.path) for r in sorted(listed.collect())}
    if not out:
        raise ValueError(f"no export of the session in {path}")
    return out


def choose_clock(df: DataFrame, keys=(), order=()) -> str | None:
    """The first column of a clock role whose values are all there and never step back within ``keys`` in the given order; one pass."""
    clocks = sorted((c for c in df.columns if role_of(c) in CLOCKS), key=lambda c: CLOCKS.index(role_of(c)))
    if not clocks:
        return None
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(f"v{k}") for k, c in enumerate(clocks)], *[(F.expr(f"try_cast(`{c}` as double)") < F.lag(F.expr(f"try_cast(`{c}` as double)")).over(w)).alias(f"b{k}") for k, c in enumerate(clocks)])
    r = d.agg(F.count("*").alias("n"), *[F.count(f"v{k}").alias(f"n{k}") for k in range(len(clocks))], *[F.count_if(f"b{k}").alias(f"s{k}") for k in range(len(clocks))]).first()
    return next((c for k, c in enumerate(clocks) if r["n"] and r[f"n{k}"] == r["n"] and not r[f"s{k}"]), None)
