"""Sessions with the settings that the library wants."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configured(builder: SparkSession.Builder, **more: str) -> SparkSession.Builder:
    """The builder with the library's settings; `more` wins."""
    return builder.config(map=SETTINGS | more)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session in this process, for tests and small data."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("sparkloom")
    spark = configured(builder, **{"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store; one that has gone is no error."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone, and with it the need to tidy up
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a temporary one, but only if all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextlib.contextmanager
def set_to(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """The session's setting for the actions inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidied(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """The shuffle files of each action inside go as soon as it is done; without, they stay until the driver happens to collect its garbage."""
    return set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Arrow functions of the actions inside get so many rows at once, at most."""
    return set_to(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: Where the tables of materialised() lie, until released() or the end of the driver.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialised(df: DataFrame, per_file: int = 0) -> DataFrame:
    """df written and read again, in the folder that spark.checkpoint.dir names: lineage ends, and any executor can go on from there.

    Files have `per_file` rows at most, if given: readers and writers hold a file's large values all at once. The table goes with released(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("maxRecordsPerFile", per_file).parquet(path)
    atexit.register(discarded, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def released(*tables: DataFrame | None) -> None:
    """Deletes tables of materialised() whose last reader is done; other tables stay."""
    for t in tables:
        if t is not None and (path := _paths.pop(t, None)):
            discarded(t.sparkSession, path)
