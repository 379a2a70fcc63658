"""Writers: the order-line table with its load audit, and result files.

A load is staged in a folder of its own inside the table, kept lines and rejected rows side by side in one write. It
counts from the moment its manifest is there: a small numbered file under ``_loads``, put in place by a rename
that fails if the number is taken. Readers only see folders that manifests name, so a load that dies is not there,
and one that is tried again, or given twice, is there once.
"""

from __future__ import annotations

import dataclasses
import datetime
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.expr import line_flags
from tallyworks.operators import cleaning
from tallyworks.plans.star import StarTables
from tallyworks.session import free_shuffles, open_writers
from tallyworks.sources import loads, schema
from tallyworks.sources.flat import read_flat, write_flat  # noqa: F401  write_flat is one of the writers
from tallyworks.sources.loads import Load


def fingerprint(raw: DataFrame) -> str:
    """What identifies the rows of a raw table whatever their order: headers, count, and sums of two hashes of each."""
    cells = [F.col(f"`{c}`") for c in raw.columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")) for seed in (1, 2)]
    return " ".join(map(str, [*raw.columns, *raw.agg(F.count(F.lit(1)), *sums).first()]))


def stage_lines(raw: DataFrame, path: str, returned_orders: DataFrame | None = None, number_rows: bool = False) -> DataFrame:
    """Write the cleaned lines of a raw table and its rejected rows to ``path``, by outcome and year; returns what was written.

    One pass over the prepared rows; only where lines are numbered the rejected ones go their own way, since they
    take no numbers. A rejected row has its reason and its cells as JSON.
    """
    prepared = cleaning.prepare_lines(raw)
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cleaning.conform(raw).columns]))
    rejected = F.col("reject_reason").isNotNull()
    prepared = prepared.withColumn("raw_row", F.when(rejected, cells))
    if number_rows or cleaning.needs_numbers(prepared.columns):
        kept = cleaning.finish_lines(prepared.where(~rejected), returned_orders, True, schema.REJECT_COLUMNS)
        rows = kept.unionByName(prepared.where(rejected).select(*schema.REJECT_COLUMNS), allowMissingColumns=True)
    else:
        rows = cleaning.finish_lines(prepared, returned_orders, False, schema.REJECT_COLUMNS)
    rows = rows.withColumn("outcome", F.when(F.col("reject_reason").isNull(), loads.KEPT).otherwise(loads.REJECTED))
    _write_by_year(rows, path)
    return raw.sparkSession.read.schema(rows.schema).parquet(path)


def _write_by_year(rows: DataFrame, path: str) -> None:
    """Every task writes its rows where it has them, a file for each of its years: order files come by date, and the
    cleaned rows, some 40 columns, are the widest of a load. No shuffle and no sort is made for the layout. What earlier
    steps shuffled, such as the joins behind the raw rows, goes first."""
    free_shuffles(rows.sparkSession)
    with open_writers(rows.sparkSession):
        rows.write.mode("overwrite").option("compression", schema.COMPRESSION).partitionBy("outcome", "year").parquet(path)


def outcome_counts(written: DataFrame) -> dict[str | None, int]:
    """Rows of a staged load by reject reason, None for those that are kept; counted from the files."""
    return {row[0]: row[1] for row in written.groupBy("reject_reason").agg(F.count(F.lit(1))).collect()}


def load_order_lines(
    raw: DataFrame,
    table_path: str,
    audit_path: str,
    filename: str,
    file_size_bytes: int = 0,
    replace: bool = True,
    returned_orders: DataFrame | None = None,
    number_rows: bool = False,
    load_id: str | None = None,
) -> dict:
    """Clean and store a raw table, replacing or extending the old one, and log the load.

    A load is known by its file name and ``load_id``, or without one by a fingerprint of its rows, which costs
    a scan. Extending a table by a load that it holds changes nothing and returns what was logged then; so does
    replacing it by the one load it holds. A load that fails leaves the table as it was, and an audit row
    with its error. Counts are taken from the files that were written.
    """
    spark, began = raw.sparkSession, time.monotonic()
    try:
        name = loads.load_name(f"{filename}\n{load_id or fingerprint(raw)}")
        held = loads.live_loads(spark, table_path)
        known = next((load for load in held if load.name == name), None)
        if known is None or replace and len(held) > 1:
            if known is None:
                written = stage_lines(raw, f"{table_path}/load={name}", returned_orders, number_rows)
                counts = outcome_counts(written)
                kept = counts.pop(None, 0)
                known = Load(
                    name=name,
                    filename=filename,
                    file_size_bytes=file_size_bytes,
                    total_rows=kept + sum(counts.values()),
                    valid_rows=kept,
                    rejected=counts,
                    column_mappings=cleaning.column_mapping(raw.columns),
                    warnings=cleaning.cleaning_warnings(raw.columns),
                    columns=raw.columns,
                    schema=written.schema.json(),
                )
            known = loads.commit(spark, table_path, dataclasses.replace(known, replaces=replace))
    except Exception as error:
        summary = f"{type(error).__name__}: {error}"[:1000]
        record_load(spark, f"{audit_path}/load=failed-{uuid.uuid4().hex}", filename, file_size_bytes, 0, 0, "FAILED", summary)
        raise
    # Written again by a load that is tried again, with the same content.
    place = f"{audit_path}/load={known.number:09d}-{loads.load_name(table_path)}"
    total, valid = known.total_rows, known.valid_rows
    record_load(spark, place, filename, known.file_size_bytes, total, valid, uploaded_at=known.committed_at)
    return {
        "filename": filename,
        "total_rows": total,
        "valid_rows": valid,
        "invalid_rows": total - valid,
        "status": "SUCCESS",
        "load_id": name,
        "rejected": known.rejected,
        "columns_detected": known.columns,
        "column_mappings": known.column_mappings,
        "warnings": known.warnings,
        "duration_seconds": round(time.monotonic() - began, 2),
    }


def apply_returns(
    spark: SparkSession, table_path: str, audit_path: str, returned_orders: DataFrame, filename: str, load_id: str | None = None
) -> dict:
    """Flag the lines of a table of loads whose orders a later ledger (order_id) names.

    Only the years with lines to flag are written again, into a load of their own that holds these years from its
    commit on; the files of other years stay. The same ledger flags once, and one without such lines changes nothing.
    A load that is committed meanwhile makes it start over.
    """
    name = loads.load_name(f"returns\n{filename}\n{load_id or fingerprint(returned_orders)}")
    ledger = None
    while True:
        held = loads.all_loads(spark, table_path)
        known = next((load for load in held if load.name == name), None)
        if known is None:
            ledger = ledger or cleaning.read_ledger(returned_orders)
            lines = read_flat(spark, table_path)
            late = cleaning.in_ledger(lines.where("not is_returned").select("order_id", "year"), ledger, "_late").where("_late")
            years = {row[0]: row[1] for row in late.groupBy("year").agg(F.count(F.lit(1))).collect()}
            before = lines.where(F.col("year").isin(list(years)))
            flagged = cleaning.in_ledger(before, ledger, "_late")
            flagged = flagged.withColumn("is_returned", F.col("is_returned") | F.col("_late")).drop("_late")
            rows = flagged.withColumns(line_flags()).select(*lines.columns).withColumn("outcome", F.lit(loads.KEPT))
            path = f"{table_path}/load={name}"
            _write_by_year(rows, path)
            flips = sum(years.values())
            new = Load(name, filename, 0, flips, flips, {}, {}, [], ["order_id"], rows.schema.json(), revises=sorted(years))
            try:
                known = loads.commit(spark, table_path, new, after=max((load.number for load in held), default=0))
            except loads.NewerLoad:
                continue
        place = f"{audit_path}/load={known.number:09d}-{loads.load_name(table_path)}"
        record_load(spark, place, filename, 0, known.total_rows, known.valid_rows, uploaded_at=known.committed_at)
        return {"filename": filename, "flagged_lines": known.valid_rows, "years": known.revises, "status": "SUCCESS"}


def record_load(
    spark: SparkSession,
    path: str,
    filename: str,
    file_size_bytes: int,
    total: int,
    valid: int,
    status: str = "SUCCESS",
    error: str | None = None,
    uploaded_at: str | None = None,
) -> None:
    """The audit row of a load, in a folder of its own; writing it again replaces it."""
    when = datetime.datetime.fromisoformat(uploaded_at) if uploaded_at else datetime.datetime.now(datetime.timezone.utc)
    row = [(filename, file_size_bytes, total, valid, total - valid, status, error, when)]
    spark.createDataFrame(row, schema.AUDIT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def latest_loads(spark: SparkSession, audit_path: str, limit: int = 10) -> DataFrame:
    audit = spark.read.schema(schema.AUDIT_SCHEMA).option("basePath", audit_path).parquet(audit_path)
    return audit.drop("load").orderBy(F.col("uploaded_at").desc()).limit(limit)


def write_csv(result: DataFrame, path: str, compression: str | None = None) -> None:
    """A result with its header, as many files as it has partitions, compressed on request by a codec of Spark's CSV files."""
    writer = result.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_star_csv(star: StarTables, path: str) -> None:
    """One CSV folder per star schema table."""
    for field in dataclasses.fields(star):
        write_csv(getattr(star, field.name), f"{path}/{field.name}")


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per named report."""
    for name, result in reports.items():
        write_csv(result, f"{path}/{name}")
