"""Small order-line frames for tests."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.expr import calendar_columns, line_flags

SCHEMA = (
    "order_id string, order_date date, ship_date date, ship_mode string, customer_id string, customer_name string, "
    "segment string, country string, city string, state string, postal_code string, market string, region string, "
    "product_id string, category string, sub_category string, product_name string, sales decimal(18,4), quantity bigint, "
    "discount decimal(7,4), profit decimal(18,4), unit_price decimal(18,4), shipping_cost decimal(18,4), "
    "order_priority string, is_returned boolean, shipping_days int"
)

DEFAULTS = {
    "order_id": "O1", "order_date": datetime.date(2011, 1, 3), "ship_date": datetime.date(2011, 1, 5),
    "ship_mode": "First Class", "customer_id": "C1", "customer_name": "Ann", "segment": "Consumer", "country": "France",
    "city": "Lyon", "state": "Rhone", "postal_code": "69001", "market": "EU", "region": "Central", "product_id": "P1",
    "category": "Office", "sub_category": "Paper", "product_name": "Sheet", "sales": 10, "quantity": 1, "discount": 0,
    "profit": 1, "unit_price": 10, "shipping_cost": 0, "order_priority": "Medium", "is_returned": False, "shipping_days": 2,
}

DECIMALS = ("sales", "discount", "profit", "unit_price", "shipping_cost")


def make_lines(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Lines with the given cells; everything else takes a default."""
    names = [part.split()[0] for part in SCHEMA.replace("(18,4)", "").replace("(7,4)", "").split(", ")]
    full = []
    for row in rows:
        cells = DEFAULTS | row
        full.append(tuple(Decimal(str(cells[n])) if n in DECIMALS and cells[n] is not None else cells[n] for n in names))
    lines = spark.createDataFrame(full, SCHEMA)
    return lines.withColumns(line_flags()).withColumns(calendar_columns(F.col("order_date")))


def rows_of(df: DataFrame) -> list[dict]:
    return [row.asDict() for row in df.collect()]
