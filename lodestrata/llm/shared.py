"""Shared-folder storage, text words and seeded hashing used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, which only a local
    master may leave it, a temporary folder that goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = path = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, path, True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read back: it is computed once, has no lineage, and
    survives the loss of any executor. Its shuffle files go once it is written. Files stand apart by a column, if one is named."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Deletes what keep() wrote, when nothing that is still to run reads it."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget_part(kept: DataFrame, by: str, value: int) -> None:
    """Deletes the rows of one value of the column by which keep() set files apart."""
    path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{kept._kept_at}/{by}={value}")
    path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def file_system(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """array<string> of the words [^\\x20\\x09-\\x0D]+ of text, which is not null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def small_batches(spark: SparkSession, rows: int = 128, size: int = 8 << 20) -> None:
    """Whole texts go to Python in Arrow batches; this bounds their rows and bytes, so that a batch of long
    texts stays small (one text is the least). The bounds stay set in the session, as plans are run later;
    results do not depend on them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(key).lower().rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def tidy(run):
    """A function for mapInArrow that gives the memory it freed back to the system when a task ends: workers live on
    beside the next stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied
