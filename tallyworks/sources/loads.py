"""The manifests of a table that is filled load by load, and what its readers see."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEPT, REJECTED = "kept", "rejected"
MANIFESTS = "_loads"  # readers of data skip names that begin with an underscore
TRIES = 100


@dataclasses.dataclass(frozen=True)
class Load:
    """What is known of a load. ``replaces`` takes all earlier loads out of the table, ``revises`` some years of them."""

    name: str
    filename: str
    file_size_bytes: int
    total_rows: int
    valid_rows: int
    rejected: dict[str, int]
    column_mappings: dict[str, str]
    warnings: list[str]
    columns: list[str]
    schema: str  # of the files, as JSON
    replaces: bool = False
    revises: list[int] = dataclasses.field(default_factory=list)  # years that this load holds for all earlier ones
    number: int = 0  # in the order of commits, from 1
    committed_at: str = ""


def load_name(text: str) -> str:
    """A folder name for any text; its letter keeps it from being read as a number."""
    return "l" + hashlib.sha256(text.encode()).hexdigest()[:24]


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def all_loads(spark: SparkSession, table_path: str) -> list[Load]:
    """Every committed load in order, one small row each."""
    files, folder = _files(spark, f"{table_path}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    rows = spark.read.text(f"{table_path}/{MANIFESTS}", wholetext=True).collect()
    return sorted((Load(**json.loads(row[0])) for row in rows), key=lambda load: load.number)


def live_loads(spark: SparkSession, table_path: str) -> list[Load]:
    """The loads whose rows the table holds, each once."""
    live: dict[str, Load] = {}
    for load in all_loads(spark, table_path):
        if load.replaces:
            live = {}
        live[load.name] = load
    return list(live.values())


class NewerLoad(Exception):
    """Another load was committed since the table was read."""


def commit(spark: SparkSession, table_path: str, load: Load, after: int | None = None) -> Load:
    """Put the manifest in place under the next free number. A rename never overwrites, so two writers get two numbers.

    ``after`` is the last number the load knows of; it is not committed if there is a newer one.
    """
    files, folder = _files(spark, f"{table_path}/{MANIFESTS}")
    files.mkdirs(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    number = max((known.number for known in all_loads(spark, table_path)), default=0)
    for _ in range(TRIES):
        if after is not None and number != after:
            raise NewerLoad(f"{table_path} has load {number}, not {after}")
        number += 1
        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
        load = dataclasses.replace(load, number=number, committed_at=now)
        draft, target = path(folder, f"_draft-{uuid.uuid4().hex}"), path(folder, f"{number:09d}.json")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(dataclasses.asdict(load)).encode()))
        stream.close()
        if not files.exists(target) and files.rename(draft, target):
            return load
        files.delete(draft, False)
    raise RuntimeError(f"no free manifest number in {table_path}")


def read_loads(spark: SparkSession, table_path: str, outcome: str) -> DataFrame | None:
    """Rows of one outcome of the live loads, with their load; None where the table has no manifests."""
    if not all_loads(spark, table_path):
        return None
    live = live_loads(spark, table_path)
    fields = {field.name: field for load in live for field in StructType.fromJson(json.loads(load.schema)).fields}
    schema = StructType(list(fields.values())).add("load", "string")
    paths = [f"{table_path}/load={load.name}" for load in live]
    rows = spark.read.schema(schema).option("basePath", table_path).parquet(*paths).where(F.col("outcome") == outcome)
    for load in live if outcome == KEPT else []:
        years = sorted({year for newer in live if newer.number > load.number for year in newer.revises})
        if years:  # on partition columns alone, so these folders are not read
            rows = rows.where((F.col("load") != load.name) | F.col("year").isNull() | ~F.col("year").isin(years))
    return rows


def remove_stale(spark: SparkSession, table_path: str) -> list[str]:
    """Delete the folders that no live load names: of replaced loads, and of loads that died. No load may be running."""
    files, folder = _files(spark, table_path)
    live = {f"load={load.name}" for load in live_loads(spark, table_path)}
    found = [status.getPath() for status in files.listStatus(folder)]
    stale = [path for path in found if path.getName().startswith("load=") and path.getName() not in live]
    for path in stale:
        files.delete(path, True)
    return sorted(path.getName().removeprefix("load=") for path in stale)
