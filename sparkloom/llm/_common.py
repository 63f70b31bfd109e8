"""What the operators of this package share: table access, shared storage, and sizes of work."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset a temporary one, but only if all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone, and with it the need to tidy up
        pass


#: Where the tables of stored() lie, until released() or the end of the session.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends here, and a lost executor costs only the tasks that ran on it.

    The shuffle files of the plan go as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Deletes tables of stored() whose last reader is done; other tables stay."""
    for t in tables:
        if t is not None and (path := _paths.pop(t, None)):
            _remove(t.sparkSession, path)


#: Rows and bytes of a batch for Arrow functions, where the session doesn't say.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches of Arrow functions by bytes, so that a worker's memory doesn't grow with the texts. The session's own settings win."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the column's text form, modulo n; a null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % n


#: Narrow rows of a table that may be broadcast, at most (some 20 MB on each executor).
SMALL_ROWS = 1 << 18


def small(rows: int) -> Callable[[DataFrame], DataFrame]:
    """How to join a table of narrow rows that has been counted: broadcast up to SMALL_ROWS, else as Spark plans it."""
    return F.broadcast if rows <= SMALL_ROWS else lambda df: df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
