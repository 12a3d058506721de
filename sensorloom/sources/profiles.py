"""Profiles of export folders with many headers, and layout checks, from one scan of the files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.core import union_all
from .exports import MISSING

# Roles by patterns of upper-case column names; the first that fits counts.
PATTERNS = (
    ("time", "TIME|TICK|CNT|^MSTIMER$"), ("ttl_event", "^TTL|MARKER|USER_DATA|USER$|EVENT"), ("aoi", "AOI|AREA_OF_INTEREST|INTEREST_AREA|IA_"), ("pupil", "PUPIL|LPMM|RPMM|LPD|RPD"),
    ("eda_gsr", "GSR|EDA|SCR|SCL|PHASIC|TONIC"), ("heart_rate", "^(HR|BPM)$|HEART"), ("ibi_rr", "IBI|RRI|RR_INTERVAL|RR$|NNI|NN_INTERVAL"), ("ppg_pulse", "PPG|PULSE|HRP|BVP"),
    ("engagement_dial", "DIAL|ENGAGEMENT"), ("gaze", "FPOG|BPOG|LPOG|RPOG|GAZE|X$|Y$"),
)
SIGNALS = ("gaze", "pupil", "eda_gsr", "heart_rate", "ibi_rr", "ppg_pulse", "engagement_dial")
SEPARATORS = (",", ";", "\t")
#: Headers of at most this many files are sent to all executors.
FEW_FILES = 10_000
# Files that a layout has at its root, and names of exports.
ROOT_FILES = ("dataset_description.json", "participants.tsv")
EXPORT_NAMES = ("all[_-]?gaze", "fixation", "summary", "biometric", "eda", "gsr", "ecg", "ppg", "hr", "ibi")


def profile_role(column: Column) -> Column:
    name, out = F.upper(column), F.when(F.lit(False), F.lit(""))
    for role, pattern in PATTERNS:
        out = out.when(name.rlike(pattern), role)
    return out.otherwise("other")


def _listing(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    """(file, size_bytes, modified_time) of the files; contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return d.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"))


def melted(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = False, missing=MISSING) -> tuple[DataFrame, DataFrame]:
    """(file, sep, names) of every header, and (file, place, value) of every cell below one.

    All files, whatever their columns, are one scan of lines. A file's header is
    the first line of its first split; lines meet it by file and are parsed by its
    separator. Quoted fields do not span lines.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    head = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("first"))
    head = head.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))
    count = lambda s: F.length("header") - F.length(F.replace("header", F.lit(s)))
    most = F.greatest(*map(count, SEPARATORS))
    sep = F.lit(SEPARATORS[-1])
    for s in reversed(SEPARATORS[:-1]):
        sep = F.when(count(s) == most, s).otherwise(sep)
    head = head.withColumn("sep", sep).withColumn("width", most + 1)
    widest, files = head.agg(F.coalesce(F.max("width"), F.lit(1)), F.count("*")).first()  # two numbers
    schema = ", ".join(f"c{k} string" for k in range(widest))

    def cells(line: str) -> Column:
        out = F.lit(None)
        for s in SEPARATORS:
            row = F.from_csv(line, schema, {"sep": s, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
            out = F.when(F.col("sep") == s, F.array(*[row[f"c{k}"] for k in range(widest)])).otherwise(out)
        return F.slice(out, F.lit(1), F.col("width"))

    heads = head.select("file", "sep", "width", "first")
    # a join by file would put all lines of a file into one task
    body = lines.join(F.broadcast(heads) if files <= FEW_FILES else heads, "file").where("line <> first and trim(value) <> ''")
    value = F.when(~F.col("value").isin(*missing), F.col("value"))
    long = body.select("file", F.posexplode(cells("value")).alias("place", "value")).select("file", "place", value.alias("value"))
    return head.select("file", "sep", F.transform(cells("header"), lambda c, k: F.coalesce(c, F.concat(F.lit("Unnamed: "), k.cast("string")))).alias("names")), long


def profile_folder(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = False, missing=MISSING) -> dict[str, DataFrame]:
    """Tables 'columns' (a row a file and column), 'files', 'overview' (one row) and 'warnings' of a folder of exports.

    A column is numeric where it has rows and every present value is a number; files
    whose header cannot be read are
    read errors, and Spark does not list files of no bytes. A folder without matching files has empty tables and says so.
    """
    head, cells = melted(spark, path, pattern, recursive, missing)
    number = F.expr("try_cast(value as double)")
    # rows are dealt by value before values are counted, so that no task holds a whole split's distinct values three times over
    values = cells.repartition("file", "place", "value").groupBy("file", "place", "value").agg(F.count("*").alias("w"))
    texts = values.groupBy("file", "place").agg(F.sum("w").alias("n_rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("w"))).alias("n"), F.count("value").alias("n_texts"))
    numbers = values.groupBy("file", "place", number.alias("x")).agg(F.sum("w").alias("w")).where("x is not null")
    numbers = numbers.groupBy("file", "place").agg(F.sum("w").alias("n_numbers"), F.count("*").alias("n_values"))
    spread = cells.groupBy("file", "place").agg(F.stddev_samp(number).alias("sd"), F.min(number).alias("low"), F.max(number).alias("high"))
    stats = texts.join(numbers, ["file", "place"], "left").join(spread, ["file", "place"])
    names = head.select("file", F.posexplode("names").alias("place", "column"))
    c = names.join(stats, ["file", "place"], "left").fillna(0, ["n_rows", "n", "n_numbers", "n_texts", "n_values"])
    numeric = (F.col("n_numbers") == F.col("n")) & (F.col("n_rows") > 0)
    unique = F.when(numeric, F.col("n_values")).otherwise(F.col("n_texts"))
    columns = c.select(
        "file", "place", "column", profile_role(F.col("column")).alias("role"), F.when(numeric, "numeric").otherwise("character").alias("type"), "n_rows", (F.col("n_rows") - F.col("n")).alias("n_missing"),
        F.try_divide(F.col("n_rows") - F.col("n"), F.col("n_rows")).alias("missing_prop"), unique.alias("n_unique"), F.when(numeric, F.col("sd")).alias("numeric_sd"),
        (numeric & (F.col("n") > 0) & (F.col("low") == 0) & (F.col("high") == 0)).alias("all_zero"), F.when(F.col("n") > 0, unique <= 1).alias("constant"))
    columns = columns.withColumn("all_zero", F.coalesce("all_zero", F.lit(False)))
    num = F.col("type") == "numeric"
    of_role = lambda r: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("place", "column")))), lambda s: s["column"]), "; "), F.lit(""))
    by_file = columns.groupBy("file").agg(
        F.max("n_rows").alias("n_rows"), F.count("*").alias("n_cols"), F.array_join(F.array_sort(F.collect_list("column")), " | ").alias("column_signature"), *[of_role(r).alias(f"{r}_columns") for r, _ in PATTERNS],
        F.count_if(num).alias("numeric_cols"), F.count_if(num & (F.col("n_unique") <= 1)).alias("constant_numeric_cols"), F.count_if(F.col("all_zero")).alias("zero_numeric_cols"))
    # listings and scans write the same path with one slash or three
    plain = lambda f: F.regexp_replace(f, "^file:/+", "file:/")
    listed = _listing(spark, path, pattern, recursive).withColumn("_f", plain("file"))
    files = listed.join(by_file.withColumn("_f", plain("file")).drop("file"), "_f", "left").drop("_f")
    files = files.withColumn("file_label", F.element_at(F.split("file", "/"), -1)).withColumn("extension", F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1)))
    files = files.withColumn("status", F.when(F.col("n_cols").isNull(), "read_error").otherwise("readable")).fillna(0, ["n_rows", "n_cols", "numeric_cols", "constant_numeric_cols", "zero_numeric_cols"])
    any_of = lambda *roles: F.coalesce(F.bool_or(F.col("role").isin(*roles)), F.lit(False))
    seen = columns.agg(any_of("time").alias("any_time_columns"), any_of("ttl_event").alias("any_ttl_columns"), any_of("aoi").alias("any_aoi_columns"), any_of(*SIGNALS).alias("any_signal_columns"))
    ok = F.col("status") == "readable"
    total = files.agg(F.count("*").alias("n_files"), F.count_if(ok).alias("n_readable_files"), F.count_if(~ok).alias("n_read_errors"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows_profiled"),
                      F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"), F.count_distinct("extension").alias("n_unique_extensions"), F.count_distinct(F.when(ok, F.col("column_signature"))).alias("n_unique_column_sets"))
    overview = total.join(F.broadcast(seen))  # one row each
    rules = (("warning", "no_matching_files", F.col("n_files") == 0), ("warning", "read_errors", F.col("n_read_errors") > 0), ("error", "no_readable_files", F.col("n_readable_files") == 0),
             ("warning", "no_time_columns_detected", ~F.col("any_time_columns")), ("warning", "no_signal_columns_detected", ~F.col("any_signal_columns")))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for s, i, c in rules]))
    return {"columns": columns, "files": files, "overview": overview, "warnings": overview.select(F.explode(found).alias("w")).select("w.*")}


def compare_profiles(profiles: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """'overview' of all, 'role_coverage' (profile, role, n_columns) and 'column_presence' (column, n_profiles_present, profiles_present)."""
    if len(profiles) < 2:
        raise ValueError("a comparison takes two profiles or more")
    order = F.array(*map(F.lit, profiles))
    columns = union_all([p["columns"].select(F.lit(n).alias("profile"), "column", "role") for n, p in profiles.items()])
    present = columns.groupBy("column").agg(F.collect_set("profile").alias("_p"))
    listed = F.filter(order, lambda n: F.array_contains("_p", n))
    return {"overview": union_all([p["overview"].select(F.lit(n).alias("profile"), "*") for n, p in profiles.items()]), "role_coverage": columns.groupBy("profile", "role").agg(F.count("*").alias("n_columns")),
            "column_presence": present.select("column", F.size("_p").cast("long").alias("n_profiles_present"), F.array_join(listed, "; ").alias("profiles_present"))}


def check_layout(spark: SparkSession, root: str, subjects: str = "^sub-[A-Za-z0-9]+$", expected=ROOT_FILES, exports=EXPORT_NAMES) -> DataFrame:
    """(check, status, detail) of a data set's folder tree, taken as a table of paths.

    Only names are read. Folders count by the files in them, so an empty subject
    folder is not seen. A root that is not there fails.
    """
    schema = "check string, status string, detail string"
    try:
        paths = _listing(spark, root, "*", True).select("file")
    except AnalysisException:
        return spark.createDataFrame([("root_directory", "fail", "Root directory does not exist.")], schema)
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
    parts = paths.select(F.split(F.substring_index("file", f"{base}/", -1), "/").alias("p")).select(F.size("p").alias("depth"), F.element_at("p", 1).alias("top"), F.element_at("p", -1).alias("name"))
    wanted = spark.createDataFrame([(f,) for f in expected], "name string")
    absent = wanted.join(parts.where("depth = 1"), "name", "left_anti").select("name", F.lit(True).alias("absent"))
    files = wanted.join(absent, "name", "left").select(F.col("name").alias("check"), F.when(F.col("absent"), "warn").otherwise("pass").alias("status"), F.when(F.col("absent"), "Missing expected root file.").otherwise("Present.").alias("detail"))
    is_subject, is_export = (F.col("depth") > 1) & F.col("top").rlike(subjects), F.lower("name").rlike("|".join(exports))
    n = parts.agg(F.count_distinct(F.when(is_subject, F.col("top"))).alias("s"), F.count_if(is_export).alias("e"))
    told = lambda check, c, text: F.struct(F.lit(check).alias("check"), F.when(F.col(c) > 0, "pass").otherwise("warn").alias("status"), F.concat(F.col(c).cast("string"), F.lit(text)).alias("detail"))
    counts = n.select(F.explode(F.array(told("subject_directories", "s", " subject directories detected."), told("export_files", "e", " export files detected."))).alias("r")).select("r.*")
    return spark.createDataFrame([("root_directory", "pass", "Root directory exists.")], schema).unionByName(files).unionByName(counts)


def layout_summary(checks: DataFrame) -> DataFrame:
    """One row: checks by status, and whether the layout is ready and needs a look."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.agg(F.count("*").alias("n_checks"), n("pass").alias("n_pass"), n("warn").alias("n_warn"), n("fail").alias("n_fail"), (n("fail") == 0).alias("layout_ready"), (n("fail") + n("warn") > 0).alias("needs_review"))
