"""Incremental loads: new order files are cleaned and appended as they arrive, one audit row per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyworks.sources import schema as formats
from tallyworks.sources.files import present_cells
from tallyworks.sources.loads import KEPT
from tallyworks.sources.sinks import outcome_counts, record_load, stage_lines


def stream_order_files(
    spark: SparkSession, folder: str, schema: StructType | str, encoding: str = "utf-8", once_within: str | None = None
) -> DataFrame:
    """Raw order files of a folder as a stream. A stream's columns are given, never guessed.

    With ``once_within`` (such as ``7 days``) a row that is equal in every cell to one of a file changed less than
    that before is dropped, whichever file it comes in; the state store forgets rows as files get newer.
    """
    raw = spark.readStream.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"').csv(folder)
    if once_within:
        cells = raw.columns
        timed = raw.withColumn("_changed", F.col("_metadata.file_modification_time")).withWatermark("_changed", once_within)
        raw = timed.dropDuplicatesWithinWatermark(cells).drop("_changed")
    return present_cells(raw)


def start_ingest(
    raw: DataFrame,
    table_path: str,
    audit_path: str,
    checkpoint_path: str,
    returned_orders: DataFrame | None = None,
) -> StreamingQuery:
    """Clean every batch of new rows into its own folder of the table, with the rows it leaves out beside it.

    A batch that is tried again after a failure overwrites what its first try left behind, so each
    row is stored once. The query ends when all present files are loaded.
    """

    def load(batch: DataFrame, number: int) -> None:
        counts = outcome_counts(stage_lines(batch, f"{table_path}/batch={number}", returned_orders))
        total, kept = sum(counts.values()), counts.get(None, 0)
        record_load(batch.sparkSession, f"{audit_path}/batch={number}", f"batch-{number}", 0, total, kept)

    return (
        raw.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, table_path: str) -> DataFrame:
    stored = spark.read.option("basePath", table_path).parquet(table_path)
    return stored.where(F.col("outcome") == KEPT).drop("outcome", *formats.REJECT_COLUMNS)


def read_batch_audit(spark: SparkSession, audit_path: str) -> DataFrame:
    return spark.read.schema(f"{formats.AUDIT_SCHEMA}, batch bigint").option("basePath", audit_path).parquet(audit_path)
