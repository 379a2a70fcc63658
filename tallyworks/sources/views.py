"""Names for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyworks.plans.star import StarTables

# Table names users of the schema know.
LINE_VIEWS = ["sales_transactions", "order_lines"]
STAR_VIEWS = {
    "fact": "fact_sales",
    "customer": "dim_customers",
    "product": "dim_products",
    "geography": "dim_geography",
    "shipping": "dim_shipping",
    "date": "dim_dates",
}


def register_views(lines: DataFrame, star: StarTables | None = None) -> None:
    """Temporary views of the order lines and, where given, of the star schema."""
    for name in LINE_VIEWS:
        lines.createOrReplaceTempView(name)
    if star is not None:
        for field, name in STAR_VIEWS.items():
            getattr(star, field).createOrReplaceTempView(name)
