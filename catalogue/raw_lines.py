"""A raw order file made from the trade tables: text cells, foreign headers and every known defect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(name: str):
    return F.col(name).cast("string")


def raw_order_lines(lines: DataFrame) -> DataFrame:
    order, product = F.col("order_id"), F.col("product_id")

    def every(n: int):
        return product % n == 0

    day = F.col("order_date")
    shape = (order + product) % 4
    ordered = (
        F.when(every(101), "not a date")
        .when(every(103), F.lit(None).cast("string"))
        .when(shape == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 1, F.date_format(day, "M/d/yyyy"))
        .when(shape == 2, F.date_format(day, "MM-dd-yyyy"))
        .when(F.dayofmonth(day) > 12, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy/MM/dd"))
    )
    sales = (
        F.when(every(89), "abc")
        .when(every(83), F.concat(F.lit("-"), _text("sales")))
        .when(every(79), "1.5e3")
        .when(every(5), F.concat(F.lit("$"), F.format_number(F.col("sales"), 2)))
        .when(product % 5 == 1, F.concat(_text("sales"), F.lit(" USD")))
        .otherwise(_text("sales"))
    )
    quantity = (
        F.when(every(17), "x")
        .when(every(19), F.concat(F.lit("-"), _text("quantity")))
        .when(every(23), F.concat(_text("quantity"), F.lit(".7")))
        .otherwise(_text("quantity"))
    )
    discount = (
        F.when(every(29), "-0.1")
        .when(every(31), "0.99")
        .when(order % 2 == 0, F.concat((F.col("discount") * 100).cast("decimal(7,1)").cast("string"), F.lit("%")))
        .otherwise(_text("discount"))
    )
    profit = F.when(every(37), F.concat(F.lit("("), F.abs("profit").cast("string"), F.lit(")"))).otherwise(_text("profit"))
    price = F.when(every(43), F.lit(None)).when(every(47), "n/a").otherwise(_text("unit_price"))
    return lines.select(
        F.concat(F.lit("ORD-"), _text("order_id")).alias("Order ID"),
        ordered.alias("Order Date"),
        F.when(~every(7), F.date_format("raw_ship_date", "yyyy-MM-dd")).alias("Ship Date"),
        F.when(every(11), " nan ").otherwise(F.col("ship_mode")).alias("Delivery Method"),
        F.when(order % 97 == 0, "null").otherwise(_text("customer_id")).alias("Customer ID"),
        F.col("customer_name").alias("Client Name"),
        F.when(order % 13 == 0, "None").otherwise(F.concat(F.lit(" "), "segment", F.lit(" "))).alias("Customer Segment"),
        F.col("country").alias("Nation"),
        F.col("city").alias("Town"),
        F.col("state").alias("Province"),
        F.col("postal_code").alias("Zip-Code"),
        F.col("market").alias("Continent"),
        F.col("region").alias("Zone"),
        _text("product_id").alias("SKU"),
        F.col("category").alias("Product Category"),
        F.when(every(53), "").otherwise(F.col("sub_category")).alias("Sub-Category"),
        F.col("product_name").alias("Title"),
        sales.alias("Revenue"),
        quantity.alias("QTY"),
        price.alias("Price"),
        discount.alias("Disc"),
        profit.alias("Net Profit"),
        F.when(every(41), "-3").otherwise(_text("shipping_cost")).alias("Freight"),
    )


def returns_ledger(lines: DataFrame) -> DataFrame:
    """Order ids of returned orders as a ledger gives them: one row per returned line."""
    return lines.filter("is_returned").select(F.concat(F.lit("ORD-"), _text("order_id")).alias("order_id"))
