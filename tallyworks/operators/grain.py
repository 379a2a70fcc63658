"""Reduce order lines to orders before counting, instead of expanding rows per distinct count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_order(lines: DataFrame, keys: list[str], sums: dict[str, str] | None = None, flags: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, order) with line sums and 'any line is' flags as 0/1.

    Lines are combined on the map side, so an order or key that holds a large part of all lines is
    reduced before the shuffle, which is spread by order.
    """
    aggregates = [F.count(F.lit(1)).alias("lines")]
    aggregates += [F.sum(source).alias(name) for name, source in (sums or {}).items()]
    aggregates += [
        F.max(F.when(condition, 1).otherwise(0)).alias(name) for name, condition in (flags or {}).items()
    ]
    return lines.groupBy(*keys, "order_id").agg(*aggregates)
