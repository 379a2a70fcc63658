"""Readers for order files, returns ledgers and table dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyworks.plans.star import StarTables
from tallyworks.sources.schema import MISSING_CELLS, STAR_SCHEMAS

ENCODINGS = ["utf-8", "ISO-8859-1"]


def present_cells(raw: DataFrame) -> DataFrame:
    """Texts that mean "missing" become nulls; other types stay as they are."""
    texts = {name for name, kind in raw.dtypes if kind == "string"}
    cell = lambda c: F.col(f"`{c}`")
    return raw.select(
        *[F.when(~cell(c).isin(MISSING_CELLS), cell(c)).alias(c) if c in texts else cell(c) for c in raw.columns]
    )


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless a line is not valid UTF-8; the search stops at the first such line."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return ENCODINGS[0] if bad.isEmpty() else ENCODINGS[1]


def read_orders_csv(
    spark: SparkSession, path: str, encoding: str | None = None, multiline: bool = False
) -> DataFrame:
    """An order file with a header row, every column as text.

    The encoding is found from the data unless given (``windows-1252`` needs a session of
    ``build_session``). ``multiline`` allows line breaks inside quotes, but then a file cannot be
    split between tasks.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", encoding or detect_encoding(spark, path))
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    return present_cells(raw)


def read_returns_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of returned orders from a ledger with an ``Order ID`` column."""
    ledger = read_orders_csv(spark, path)
    return ledger.select(F.col("`Order ID`").alias("order_id")).filter("order_id IS NOT NULL").distinct()


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files at a path, from their listing; no content is read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def file_identity(spark: SparkSession, path: str) -> str:
    """What identifies the files at a path without reading them: names, sizes and times of change."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    sums = [F.sum(F.xxhash64(F.lit(seed), "path", "length", "modificationTime").cast("decimal(20,0)")) for seed in (1, 2)]
    return " ".join(map(str, found.agg(F.count(F.lit(1)), *sums).first()))


def read_star_csv(spark: SparkSession, path: str) -> StarTables:
    """A star schema stored as one CSV folder per table."""
    return StarTables(**{name: read_table_csv(spark, f"{path}/{name}", types) for name, types in STAR_SCHEMAS.items()})


def read_table_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A dump of one star-schema table. The types are given; nothing is guessed."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
