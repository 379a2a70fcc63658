"""Small column expressions shared by all reports.

Money is kept as DECIMAL, so sums do not depend on row order. It is rounded half-up while still a
decimal and only then turned into a double. Ratios are computed on doubles and rounded from their
exact binary value, so 134057.705, which is stored as slightly less, becomes 134057.7.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(total, digits: int = 2) -> Column:
    return F.round(as_column(total), digits).cast("double")


def round_half_even(value, digits: int) -> Column:
    """The nearest double with so many digits, from the exact binary value; ties go to even."""
    text = F.regexp_replace(F.format_number(as_column(value), digits), ",", "")
    return text.cast("double") + 0.0  # minus zero becomes zero


def round_half_up(value, digits: int) -> Column:
    """As ``round_half_even``, but ties go away from zero, as ROUND does in SQL.

    A double is a tie only when it is a whole number of 1 / 2^(digits + 1).
    """
    value = as_column(value)
    eighths = value * float(2 ** (digits + 1))
    tie = eighths == F.rint(eighths)
    return F.when(tie, F.round(value, digits) + 0.0).otherwise(round_half_even(value, digits))


def round_scaled(value, digits: int) -> Column:
    """Scale, round half to even, scale back: how numeric array libraries round a column."""
    scale = float(10**digits)
    return F.rint(as_column(value) * scale) / scale + 0.0


def ratio(numerator, denominator) -> Column:
    """Null when the denominator is zero (SQL reports)."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def pct(numerator, denominator, digits: int = 2) -> Column:
    return round_half_up(ratio(numerator, denominator) * 100, digits)


def divide_or_zero(numerator, denominator) -> Column:
    """Zero when the denominator is zero or missing (business measures)."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def guarded_pct(numerator, denominator, digits: int = 2) -> Column:
    """Zero unless the denominator is positive (service reports)."""
    value = round_half_even(ratio(numerator, denominator) * 100, digits)
    return F.when(as_column(denominator) > 0, value).otherwise(0.0)


def guarded_ratio(numerator, denominator, digits: int = 2) -> Column:
    value = round_half_even(ratio(numerator, denominator), digits)
    return F.when(as_column(denominator) > 0, value).otherwise(0.0)


def growth_pct(current, previous, digits: int = 2) -> Column:
    current, previous = as_column(current), as_column(previous)
    return round_half_up(F.try_divide(current - previous, previous) * 100, digits)


def mean(column) -> Column:
    """Average as a double of an exact sum."""
    column = as_column(column)
    return ratio(F.sum(column), F.count(column))


def whole(total) -> Column:
    return F.coalesce(as_column(total), F.lit(0)).cast("bigint")


def calendar_columns(day) -> dict[str, Column]:
    day = as_column(day)
    return {
        "year": F.year(day),
        "quarter": F.concat(F.lit("Q"), F.quarter(day)),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "week": F.weekofyear(day),
        "day": F.dayofmonth(day),
        "day_of_week": F.date_format(day, "EEEE"),
        "year_month": F.date_format(day, "yyyy-MM"),
    }


def line_flags() -> dict[str, Column]:
    return {
        "order_status": F.when(F.col("is_returned"), "Returned").otherwise("Completed"),
        "is_profitable": F.col("profit") > 0,
        "is_discounted": F.col("discount") > 0,
        "profit_margin": round_scaled(ratio("profit", "sales"), 4),
    }


def quantile_bin(position, total, bins: int) -> Column:
    """Equal-width cut of positions 1..total into ``bins`` right-closed intervals.

    This is how a quantile cut behaves on distinct ranks. It is not NTILE: for 6 rows and 4 bins
    the sizes are 2, 1, 1, 2.
    """
    position, total = as_column(position), as_column(total)
    span = total - 1
    # Integer ceiling of (position - 1) * bins / span.
    ceiling = F.floor(((position - 1) * bins + span - 1) / F.greatest(span, F.lit(1)))
    return F.when(total > 1, F.greatest(ceiling, F.lit(1))).otherwise(1).cast("int")


def ntile_bin(position, total, bins: int) -> Column:
    """NTILE(bins) as a function of the row's position, so no single-task window is needed."""
    position, total = as_column(position), as_column(total)
    size = F.floor(total / bins)
    larger = total % bins
    in_larger = larger * (size + 1)
    return (
        F.when(position <= in_larger, F.floor((position - 1) / (size + 1)) + 1)
        .otherwise(larger + F.floor((position - 1 - in_larger) / F.greatest(size, F.lit(1))) + 1)
        .cast("int")
    )


def labelled(ladder, otherwise) -> Column:
    """First matching (condition, label) wins."""
    (condition, label), *rest = ladder
    column = F.when(condition, label)
    for condition, label in rest:
        column = column.when(condition, label)
    return column.otherwise(otherwise)
