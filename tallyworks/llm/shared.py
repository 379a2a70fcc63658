"""What the operators share: scratch tables, worker imports, and checks of broadcast sizes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyworks.session import shared_folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed on every machine; this covers local runs from another folder.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted by Hadoop's file system when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(frame: DataFrame, kind: str, *folders: str) -> DataFrame:
    """The frame written to the shared folder, in a folder per value of some columns if asked for, and read back.

    This cuts the lineage; a lost executor costs a read of the files, not the work behind them. Spark
    deletes the shuffle files behind the frame once the driver's JVM has collected their handles, so that
    is asked for here: they would otherwise pile up over the steps of one query.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, kind)
    frame.write.partitionBy(*folders).parquet(path)
    spark.sparkContext._jvm.System.gc()
    read = spark.read.schema(frame.schema).parquet(path)
    read._scratch = [path]
    return read


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored frames, once nothing that is still to be computed reads them."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for path in getattr(frame, "_scratch", []):
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def built_on(frame: DataFrame, *tables: DataFrame) -> DataFrame:
    """The frame, with a note of the stored tables it reads, for ``discard`` after it is computed."""
    frame._scratch = [path for table in tables for path in getattr(table, "_scratch", [])]
    return frame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
