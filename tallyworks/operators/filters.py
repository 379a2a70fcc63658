"""The filter context every service report accepts."""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class FilterContext:
    """Optional predicates, all AND-ed. ``None`` and ``'all'`` leave a field unfiltered."""

    year: int | None = None
    quarter: str | None = None
    month: int | None = None
    country: str | None = None
    market: str | None = None
    region: str | None = None
    state: str | None = None
    category: str | None = None
    sub_category: str | None = None
    product_id: str | int | None = None
    segment: str | None = None
    ship_mode: str | None = None
    order_status: str | None = None
    start_date: datetime.date | str | None = None
    end_date: datetime.date | str | None = None

    def predicates(self) -> list[Column]:
        found = []
        for field in dataclasses.fields(self):
            value = getattr(self, field.name)
            if value is None or value in ("all", ""):
                continue
            if field.name == "start_date":
                found.append(F.col("order_date") >= F.lit(str(value)).cast("date"))
            elif field.name == "end_date":
                found.append(F.col("order_date") <= F.lit(str(value)).cast("date"))
            else:
                found.append(F.col(field.name) == F.lit(value))
        return found

    def _years(self) -> list[Column]:
        """The years a date range lies in: stored tables are laid out by year."""
        first, last = (F.year(F.lit(str(day)).cast("date")) if day not in (None, "all", "") else None for day in (self.start_date, self.end_date))
        return [F.col("year") >= first] * (first is not None) + [F.col("year") <= last] * (last is not None)

    def apply(self, lines: DataFrame) -> DataFrame:
        """Lines that meet all predicates; a date range also prunes years where there is such a column."""
        for predicate in self.predicates() + (self._years() if "year" in lines.columns else []):
            lines = lines.filter(predicate)
        return lines


EVERYTHING = FilterContext()


def contains_any(term: str, *columns: str) -> Column:
    """Case-insensitive containment in any of the columns. Wildcard signs are plain text."""
    needle = term.strip().lower()
    found = F.lit(False)
    for name in columns:
        found = found | F.lower(F.col(name).cast("string")).contains(needle)
    return found
