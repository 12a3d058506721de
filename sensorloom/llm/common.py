"""Helpers shared by the corpus operators: table access and shared-folder tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the word contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


#: Rows and bytes of a batch that goes to Python; Spark's own default is 10,000 rows of any length.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "16m")}


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with batches for Python that whole texts do not overfill; a setting of the user's stays."""
    conf = df.sparkSession.conf
    for name, (default, ours) in BATCHES.items():
        if conf.get(name, default) == default:
            conf.set(name, ours)
    return df


def trimmed(run: Callable) -> Callable:
    """A function for ``mapInPandas`` that at its end gives freed memory back to the system, since workers live on."""

    def whole(batches):
        yield from run(batches)
        del batches
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def as_text(name: str) -> F.Column:
    """An integer column for ``mapInPandas``: as text it keeps all its digits beside NULLs, which pandas would make doubles of."""
    return F.col(name).cast("string").alias(name)


def longs(texts) -> pd.api.extensions.ExtensionArray:
    """The numbers of such a column."""
    return pd.array([None if v is None else int(v) for v in texts], "Int64")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a local one only where Spark itself is local (tests)."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints/sensorloom"


#: Spark then removes a query's shuffle files when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, rows: int | None = None, each: int = 100_000, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``, where known, is about how many rows the table has or is made from:
    tasks then take about ``each`` of them, but all cores are used.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // each)))
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing to come reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._table)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text) -> F.Column:
    """Array of maximal runs of non-space characters of a non-null text column."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def let(value, then) -> F.Column:
    """Evaluate ``value`` once and give it to ``then``: a lambda variable is a let-binding."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
