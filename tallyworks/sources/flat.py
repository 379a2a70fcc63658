"""The stored flat order-line table: written once per application, read by every report."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyworks.plans.rfm import rfm_quintiles
from tallyworks.plans.star import StarTables, build_star, read_star, write_star
from tallyworks.session import open_writers, shared_folder
from tallyworks.sources.loads import KEPT, REJECTED, read_loads
from tallyworks.sources.schema import COMPRESSION, REJECT_COLUMNS
from tallyworks.sources.tables import TABLES, derive_order_lines

_stored: dict[tuple[str, str, str], tuple[str, dict[str, StructType]]] = {}
_guards: dict[tuple[str, str, str], threading.RLock] = {}
_lock = threading.Lock()


def write_flat(lines: DataFrame, path: str, mode: str = "overwrite", laid_out: bool = False) -> None:
    """Parquet by year. The rebalance splits a hot year and merges small pieces into full files.

    Lines that are laid out already are written as they are: every task writes a file for each of its years.
    """
    if not laid_out:
        lines = lines.hint("rebalance", "year")
    with open_writers(lines.sparkSession):
        lines.write.mode(mode).option("compression", COMPRESSION).partitionBy("year").parquet(path)


def read_flat(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The lines of a stored table, of a table of loads those of the loads it holds.

    A known schema spares the job that reads it from a file.
    """
    loaded = None if schema else read_loads(spark, path, KEPT)
    if loaded is not None:
        return loaded.drop("load", "outcome", *REJECT_COLUMNS)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rows that the loads of a table left out: load, reject_reason and the cells as JSON."""
    loaded = read_loads(spark, path, REJECTED)
    if loaded is None:
        raise ValueError(f"{path} has no loads")
    return loaded.select("load", *REJECT_COLUMNS)


def _listing(spark: SparkSession, folder: str) -> str:
    """Sizes, file counts and times of the source tables, so that a changed source is noticed."""
    context = spark.sparkContext
    found = []
    for name in sorted(TABLES):
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        status, content = files.getFileStatus(path), files.getContentSummary(path)
        found.append(f"{name} {content.getLength()} {content.getFileCount()} {status.getModificationTime()}")
    return "; ".join(found)


def _once(
    spark: SparkSession, kind: str, folder: str, write: Callable[[str], dict[str, StructType]]
) -> tuple[str, dict[str, StructType]]:
    """Path and schemas of a table derived from ``folder``, written by the first caller.

    It lies in the shared folder, so it survives lost executors, and Hadoop's file system deletes it when the
    application's JVM ends. A source that changes meanwhile gets a table of its own. Only callers that
    need the same table wait for its writer.
    """
    key = (spark.sparkContext.applicationId, kind, f"{folder}\n{_listing(spark, folder)}")
    with _lock:
        guard = _guards.setdefault(key, threading.RLock())
    with guard:
        if key not in _stored:
            path = f"{shared_folder(spark)}/{kind}-{key[0]}-{hashlib.md5(key[2].encode()).hexdigest()[:12]}"
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
            _stored[key] = (path, write(path))
    return _stored[key]


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Flat order lines of the trade tables in ``folder``: joined once, then scanned by column and year."""

    def write(path: str) -> dict[str, StructType]:
        lines = derive_order_lines(spark, folder)
        write_flat(lines, path, laid_out=True)
        return {"": lines.schema}

    path, schemas = _once(spark, "order-lines", folder, write)
    return read_flat(spark, path, schemas[""])


def customer_rfm(spark: SparkSession, folder: str) -> DataFrame:
    """The customer segmentation over the same lines."""

    def write(path: str) -> dict[str, StructType]:
        table = rfm_quintiles(order_lines(spark, folder))
        table.write.mode("overwrite").parquet(path)
        return {"": table.schema}

    path, schemas = _once(spark, "customer-rfm", folder, write)
    return spark.read.schema(schemas[""]).parquet(path)


def star_tables(spark: SparkSession, folder: str) -> StarTables:
    """The star schema over the same lines."""

    def write(path: str) -> dict[str, StructType]:
        star = build_star(order_lines(spark, folder), customer_rfm(spark, folder))
        return write_star(star, path)

    return read_star(spark, *_once(spark, "star", folder, write))
