"""Business measures as aggregate columns: use them under any grouping and any filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyworks.functions.expr import divide_or_zero, mean, money, round_half_up


def total_sales() -> Column:
    return money(F.sum("sales"))


def total_profit() -> Column:
    return money(F.sum("profit"))


def profit_margin() -> Column:
    return round_half_up(divide_or_zero(F.sum("profit"), F.sum("sales")), 6)


def total_quantity() -> Column:
    return F.sum("quantity")


def total_orders() -> Column:
    return F.count_distinct("order_id")


def total_customers() -> Column:
    return F.count_distinct("customer_id")


def average_order_value() -> Column:
    return round_half_up(divide_or_zero(F.sum("sales"), F.count_distinct("order_id")), 2)


def total_cost() -> Column:
    return money(F.sum("sales") - F.sum("profit"))


def average_discount() -> Column:
    return round_half_up(mean("discount"), 6)


def weighted_discount() -> Column:
    return round_half_up(divide_or_zero(F.sum(F.col("sales") * F.col("discount")), F.sum("sales")), 6)


def average_ship_days() -> Column:
    return round_half_up(mean("shipping_days"), 6)


def sales_per_customer() -> Column:
    return round_half_up(divide_or_zero(F.sum("sales"), F.count_distinct("customer_id")), 2)


def loss_sales() -> Column:
    return F.coalesce(money(F.sum(F.when(F.col("profit") < 0, F.col("sales")))), F.lit(0.0))


def unprofitable_loss() -> Column:
    return F.coalesce(money(F.sum(F.when(F.col("profit") < 0, F.col("profit")))), F.lit(0.0))


def loss_line_rate() -> Column:
    return round_half_up(divide_or_zero(F.count_if(F.col("profit") < 0), F.count(F.lit(1))), 6)


def heavy_discount_sales(threshold: str) -> Column:
    deep = F.col("discount") > F.lit(threshold).cast("decimal(7,4)")
    return F.coalesce(money(F.sum(F.when(deep, F.col("sales")))), F.lit(0.0))


def delayed_order_rate(days: int = 5) -> Column:
    late = F.count_distinct(F.when(F.col("shipping_days") > days, F.col("order_id")))
    return round_half_up(divide_or_zero(late, F.count_distinct("order_id")), 6)


# Measures that need nothing but the order lines.
LINE_MEASURES = {
    "total_sales": total_sales,
    "total_profit": total_profit,
    "profit_margin": profit_margin,
    "total_quantity": total_quantity,
    "total_orders": total_orders,
    "total_customers": total_customers,
    "aov": average_order_value,
    "total_cost": total_cost,
    "avg_discount_simple": average_discount,
    "avg_discount_weighted": weighted_discount,
    "avg_ship_days": average_ship_days,
    "sales_per_customer": sales_per_customer,
    "loss_sales": loss_sales,
    "unprofitable_loss": unprofitable_loss,
    "loss_line_rate": loss_line_rate,
    "heavy_discount_sales": lambda: heavy_discount_sales("0.50"),
    "heavy_discount_sales_20": lambda: heavy_discount_sales("0.20"),
    "delayed_order_rate": delayed_order_rate,
}
