"""Event-time windows over a stream of events, with late events counted apart.

Counts per window live in the state store until the watermark passes the window's end. Every batch writes the windows it
changed to a folder of its own, so a batch that is tried again replaces what its first try left, and the last
batch that names a window has its counts. An event whose window had ended before its batch began is dropped by the
state store; a second, stateless query counts what arrives, so the difference is what came too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
COUNTS = "window_start timestamp, window_end timestamp, event_type string, events bigint, total decimal(38,2), batch bigint"
ARRIVALS = "window_start timestamp, event_type string, arrived bigint, batch bigint"


def stream_events(spark: SparkSession, folder: str, schema: StructType | str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    """Event files of a folder as a stream; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _windows(width: str) -> list[Column]:
    return [F.window("ts", width).alias("window"), F.col("event_type")]


def _run(frame: DataFrame, mode: str, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        frame.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_event_windows(
    events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", delay: str = "2 hours"
) -> list[StreamingQuery]:
    """Count events (ts, event_type, value) by tumbling window and type; the queries end when all present files are read.

    An event counts unless its window ended ``delay`` or more before the newest event of earlier batches. Events
    without a time are in no window. Types may be null; null values add nothing. Restarted with the same
    checkpoint, the queries go on where they ended. A count combines in every task before it meets its state.
    """
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = (
        timed.withWatermark("ts", delay)
        .groupBy(*_windows(width))
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select("window", "event_type", "events", F.col("total").cast("decimal(38,2)").alias("total"))
    )

    def count_windows(batch: DataFrame) -> DataFrame:
        return batch.select("window.start", "window.end", "event_type", "events", "total").toDF(
            "window_start", "window_end", "event_type", "events", "total"
        )

    def count_arrivals(batch: DataFrame) -> DataFrame:
        arrived = batch.groupBy(*_windows(width)).agg(F.count(F.lit(1)).alias("arrived"))
        return arrived.select(F.col("window.start").alias("window_start"), "event_type", "arrived")

    return [
        _run(counted, "update", f"{path}/windows", f"{checkpoint}/windows", count_windows),
        _run(timed, "append", f"{path}/arrivals", f"{checkpoint}/arrivals", count_arrivals),
    ]


def read_event_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, window_end, event_type, events, total, late): every window with events in time, as of its last
    batch, and how many events came too late for it; windows of late events alone have 0 events."""
    changes = spark.read.schema(COUNTS).option("basePath", f"{path}/windows").parquet(f"{path}/windows")
    keys = ["window_start", "event_type"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("window_end", "events", "total"), "batch").alias("last"))
    arrived = spark.read.schema(ARRIVALS).option("basePath", f"{path}/arrivals").parquet(f"{path}/arrivals")
    arrived = arrived.groupBy(*keys).agg(F.sum("arrived").alias("arrived"))
    same = (F.col("a.window_start") == F.col("l.window_start")) & F.col("a.event_type").eqNullSafe(F.col("l.event_type"))
    events = F.coalesce("last.events", F.lit(0))
    return arrived.alias("a").join(last.alias("l"), same, "left").select(
        "a.window_start",
        F.col("last.window_end").alias("window_end"),
        "a.event_type",
        events.alias("events"),
        F.col("last.total").alias("total"),
        (F.col("arrived") - events).alias("late"),
    )
