"""Global positions, ranks and exact percentiles without pulling everything into one task.

A window without PARTITION BY moves all rows to one task. Here rows are laid out by range over the
whole cluster, the layout is cut by a checkpoint so that it cannot change between reads, and the
number of rows in earlier partitions is added to each row's place in its own partition. Only one
row per partition is ever gathered.
"""

from __future__ import annotations

import functools
import math
import operator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.session import shared_folder

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def _laid_out(df: DataFrame, order: list[Column]) -> DataFrame:
    shared_folder(df.sparkSession)
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    mark = F.monotonically_increasing_id()
    return laid.withColumn("_mark", mark).select(
        *df.columns,
        F.shiftright("_mark", _SLOT_BITS).alias("_part"),
        F.col("_mark").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)).alias("_slot"),
    )


def with_position(df: DataFrame, order: list[Column], position: str = "position", total: str | None = None) -> DataFrame:
    """Add the row's 1-based place in the given total order, and optionally the row count.

    ``order`` must end in a unique key, so that ties have one answer and a value shared by many
    rows is still split over partitions.
    """
    laid = _laid_out(df, order)
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the layout.
    earlier = sizes.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    columns = [*df.columns, (F.col("_before") + F.col("_slot") + 1).alias(position)]
    if total:
        columns.append(F.col("_total").alias(total))
    return laid.join(F.broadcast(earlier), "_part").select(*columns)


def _best_values(df: DataFrame, value: str, k: int, ascending: bool) -> DataFrame:
    """The ``k`` best distinct values with both of their ranks. Rows are counted by value before any is moved."""
    way = F.col("_value").asc() if ascending else F.col("_value").desc()
    counted = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows")).orderBy(way).limit(k)
    better = Window.orderBy(way).rowsBetween(Window.unboundedPreceding, -1)  # over k rows
    rank = F.coalesce(F.sum("_rows").over(better), F.lit(0)) + 1
    return counted.select("_value", F.row_number().over(Window.orderBy(way)).alias("_dense"), rank.alias("_rank"))


def _with_rank(df: DataFrame, value: str, best: DataFrame, place: str, k: int, rank: str) -> DataFrame:
    kept = best.where(F.col(place) <= k).select("_value", F.col(place).cast("int").alias("_place"))
    joined = df.join(F.broadcast(kept), F.col(value).eqNullSafe(F.col("_value")))
    return joined.select(*df.columns, F.col("_place").alias(rank))


def top_by_dense_rank(df: DataFrame, value: str, k: int, rank: str, ascending: bool = False) -> DataFrame:
    """Rows whose value is among the ``k`` best distinct values, all ties kept.

    The ``k`` values meet the rows by a broadcast, so tied rows stay where they are, however many they are.
    """
    return _with_rank(df, value, _best_values(df, value, k, ascending), "_dense", k, rank)


def top_by_rank(df: DataFrame, value: str, k: int, rank: str, ascending: bool = False) -> DataFrame:
    """Rows with RANK() <= k, all ties kept, in the same way: they have one of the ``k`` best values."""
    return _with_rank(df, value, _best_values(df, value, k, ascending), "_rank", k, rank)


BUCKETS = 1 << 16  # into which each pass of a selection divides what is left


def select_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float], kind: str = "decimal(18,4)") -> list[dict]:
    """Exact, linearly interpolated percentiles of decimal columns, with their least and largest value and count.

    A selection by passes: each counts the values of every part that holds a wanted place by ``BUCKETS`` equal steps,
    and goes on in the step that has it. Counts combine in every task, so what moves is a step per part and
    task; three passes do for values up to 2^32 units, five for all. Nothing is sorted or stored. Nulls
    don't count, and a column without values has no entry.
    """
    scale = int(kind.rstrip(")").split(",")[1])
    units = [(F.col(c).cast(kind) * 10**scale).cast("bigint").alias(f"v{i}") for i, c in enumerate(columns)]
    values = df.select(*units)
    ends = values.agg(
        *[f(f"v{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, f in (("min", F.min), ("max", F.max), ("n", F.count))]
    ).first()
    places: dict[tuple[int, int], list[int]] = {}  # (column, place) -> first and last value of its part, rows before it
    for i in range(len(columns)):
        for p in probabilities.values() if ends[f"n{i}"] else ():
            low = math.floor((ends[f"n{i}"] - 1) * p)
            for place in (low, min(low + 1, ends[f"n{i}"] - 1)):
                places[i, place] = [ends[f"min{i}"], ends[f"max{i}"], 0]
    while open_parts := sorted({(i, *part) for (i, _), part in places.items() if part[0] < part[1]}):
        steps = [(last - first) // BUCKETS + 1 for _, first, last, _ in open_parts]
        found = [
            F.when(
                F.col(f"v{i}").between(first, last),
                F.struct(F.lit(number).alias("part"), F.expr(f"(v{i} - ({first}L)) div {step}L").alias("step")),
            )
            for number, ((i, first, last, _), step) in enumerate(zip(open_parts, steps))
        ]
        each = values.select(F.explode(F.array_compact(F.array(*found))).alias("at")).select("at.*")
        counted = each.groupBy("part", "step").agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy("part").orderBy("step"))  # over the steps of a part
        counted = counted.withColumn("upto", upto)
        wanted = [
            (F.col("part") == number) & (F.col("upto") > place - before) & (F.col("upto") - F.col("rows") <= place - before)
            for number, (i, first, last, before) in enumerate(open_parts)
            for (column, place), part in places.items()
            if (column, *part) == (i, first, last, before)
        ]
        rows = counted.where(functools.reduce(operator.or_, wanted)).collect()
        for (column, place), part in places.items():
            if (column, *part) in open_parts:
                number = open_parts.index((column, *part))
                row = next(r for r in rows if r["part"] == number and r["upto"] - r["rows"] <= place - part[2] < r["upto"])
                first = part[0] + row["step"] * steps[number]
                part[:] = [first, min(first + steps[number] - 1, part[1]), part[2] + row["upto"] - row["rows"]]
    result = []
    for i, name in enumerate(columns):
        last = ends[f"n{i}"] - 1
        if last < 0:
            continue
        row = {"column": name, "total": last + 1}
        row |= {end: _exactly(ends[f"{end}{i}"], scale) for end in ("min", "max")}
        for key, p in probabilities.items():
            low = math.floor(last * p)
            a, b = (_exactly(places[i, at][0], scale) for at in (low, min(low + 1, last)))
            row[key] = a + (b - a) * (last * p - low)
        result.append(row)
    return result


def _exactly(units: int, scale: int) -> float:
    return float(Decimal(units).scaleb(-scale))


def ranges_of_values(df: DataFrame, column: str, order: Column) -> DataFrame:
    """Distinct values of a column with the 0-based places [start, stop) their rows take in the given order."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    laid = _laid_out(counted, [order])
    sizes = laid.groupBy("_part").agg(F.sum("_rows").alias("_size"))
    # One row per partition of the layout.
    earlier = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("_before") + F.col("_upto")
    return (
        laid.withColumn("_upto", F.sum("_rows").over(within))
        .join(F.broadcast(earlier), "_part")
        .select(column, (stop - F.col("_rows")).alias("start"), stop.alias("stop"))
    )


def value_histogram(df: DataFrame, columns: list[str], value_type: str = "decimal(28,4)") -> DataFrame:
    """Distinct (column, value) with row counts and the place each value takes in ascending order.

    A value covers the 0-based ranks [start, stop) of its column; ``total`` is the column's row
    count, ``amount_upto`` and ``amount_total`` are running and full sums. Equal values are combined
    before the shuffle, so a value held by a third of all rows costs one row.
    """
    # Columns travel as small numbers and get their names back at the end.
    values = F.array(*[F.col(c).cast(value_type) for c in columns])
    counted = (
        df.select(F.posexplode(values).alias("column", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    laid = _laid_out(counted, [F.col("column"), F.col("value")]).withColumn("amount", F.col("value") * F.col("rows"))
    sizes = laid.groupBy("_part", "column").agg(F.sum("rows").alias("_rows"), F.sum("amount").alias("_amount"))
    # One row per partition of the layout and column name.
    by_column = Window.partitionBy("column")
    in_order = by_column.orderBy("_part")
    earlier = sizes.select(
        "_part",
        "column",
        (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_rows_before"),
        F.sum("_rows").over(by_column).alias("total"),
        (F.sum("_amount").over(in_order) - F.col("_amount")).alias("_amount_before"),
        F.sum("_amount").over(by_column).alias("amount_total"),
    )
    within = Window.partitionBy("_part", "column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.withColumn("_rows_upto", F.sum("rows").over(within))
        .withColumn("_amount_upto", F.sum("amount").over(within))
        .join(F.broadcast(earlier), ["_part", "column"])
        .select(
            F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1).alias("column"),
            "value",
            "rows",
            "total",
            (F.col("_rows_before") + F.col("_rows_upto") - F.col("rows")).alias("start"),
            (F.col("_rows_before") + F.col("_rows_upto")).alias("stop"),
            "amount",
            (F.col("_amount_before") + F.col("_amount_upto")).alias("amount_upto"),
            "amount_total",
        )
    )


def percentiles_of(histogram: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """One row per column with linearly interpolated percentiles under the given names."""
    value, last = F.col("value").cast("double"), F.col("total") - 1

    def pieces(name: str, p: float) -> list[Column]:
        low = F.floor(last * p)
        high = F.least(low + 1, last)
        covers_low = (F.col("start") <= low) & (low < F.col("stop"))
        covers_high = (F.col("start") <= high) & (high < F.col("stop"))
        return [
            F.max(F.when(covers_low, value)).alias(f"_{name}_low"),
            F.max(F.when(covers_high, value)).alias(f"_{name}_high"),
            F.max(last * p - low).alias(f"_{name}_part"),
        ]

    gathered = histogram.groupBy("column").agg(
        *[piece for name, p in probabilities.items() for piece in pieces(name, p)]
    )
    return gathered.select(
        "column",
        *[
            (F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n)
            for n in probabilities
        ],
    )


def from_the_top(histogram: DataFrame) -> DataFrame:
    """The descending view: 1-based ranks [best, worst] of each value and the sum down to it."""
    return histogram.withColumns(
        {
            "best": F.col("total") - F.col("stop") + 1,
            "worst": F.col("total") - F.col("start"),
            "amount_down_to": F.col("amount_total") - F.col("amount_upto") + F.col("amount"),
        }
    )


def amount_of_top(best: Column, worst: Column, value: Column, k: Column) -> Column:
    """Sum of the ``k`` largest values, as an aggregate over ``from_the_top`` rows."""
    inside = F.greatest(F.least(worst, k) - best + 1, F.lit(0))
    return F.sum(value * inside)
