"""Shared by the operators: tables, written intermediate results, sizes of texts."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words, and what a word is.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Whether shuffle files go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What a task holds of a table at once, whatever its size: bytes of an Arrow batch for Python, rows that a Parquet reader decodes.
HELD = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}
#: Python workers give arrays from this size on, and free space at the end of their heap beyond that, back to the system.
FREED = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and one machine does all, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pairforge-")


def written(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: computed once, and no executor's loss can undo it.

    The shuffle files behind it go with the write, as nothing will read them again; the table goes when it is discarded,
    or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairforge-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read any more."""
    for t in tables:
        at = t._written_at
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A written table of ids, to be broadcast if they are counted and found to be at most `most`, else joined like any other."""
    return F.broadcast(ids) if ids.count() <= most else ids


def n_words(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*of: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") * (2.0**-53)


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package; a cluster gets it like any other code, by --py-files."""
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """`importable`, and texts go to Python in small batches: Spark's own are of up to 64 MB, of which a task holds several copies.

    The session keeps these settings, since plans run after they are made; smaller ones are left as they are.
    """
    for key, most in HELD.items():
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    for key, value in FREED.items():
        spark.sparkContext.environment.setdefault(key, value)
    return importable(spark)


def free_name(df: DataFrame, like: str) -> str:
    """A column name that `df` does not have."""
    have = {c.lower() for c in df.columns}
    while like.lower() in have:
        like += "_"
    return like
