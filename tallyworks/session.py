"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

# HotSpot does not compile methods above 8000 bytes; wide projections are split instead.
HUGE_METHODS, JIT_LIMIT = "spark.sql.codegen.hugeMethodLimit", "8000"


def build_session(app_name: str = "tallyworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for (ANSI on, UTC, adaptive plans)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Checkpoints of finished queries are removed with them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        HUGE_METHODS: JIT_LIMIT,
        # Windows-1252 order files are rejected by name without this.
        "spark.sql.legacy.javaCharsets": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compile_small_methods(spark: SparkSession) -> None:
    """Keep the wide projections of cleaning out of methods that only the bytecode interpreter runs.

    For sessions that others built; a limit that they set stays.
    """
    if spark.conf.get(HUGE_METHODS, None) is None:
        spark.conf.set(HUGE_METHODS, JIT_LIMIT)


@contextlib.contextmanager
def open_writers(spark: SparkSession, most: int = 64) -> Iterator[None]:
    """Inside, a task that writes by columns keeps the files of ``most`` values open and does not sort its rows first.

    Beyond that many it sorts the rest.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished work: it does so once the driver's JVM has collected their handles.

    Python lets go of a frame's handle up to a second after the frame, so call it before the next large step.
    """
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where nothing is set and the session is local, it is a folder under the session's warehouse, which Hadoop's
    file system deletes when the driver's JVM ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{context.applicationId}"
    target = context._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")
