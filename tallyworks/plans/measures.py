"""Business measures that need more than one aggregate step, and time intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.expr import divide_or_zero, money, round_half_up
from tallyworks.functions.measures import LINE_MEASURES
from tallyworks.plans.star import StarTables


def line_measure(lines: DataFrame, name: str, by: list[str]) -> DataFrame:
    return lines.groupBy(*by).agg(LINE_MEASURES[name]().alias(name))


def repeat_customers(lines: DataFrame, by: list[str]) -> DataFrame:
    """Customers with more than one order within each group, and their share."""
    return (
        lines.groupBy(*by, "customer_id")
        .agg(F.count_distinct("order_id").alias("orders"))
        .groupBy(*by)
        .agg(F.count_if(F.col("orders") > 1).alias("repeat_customers"), F.count(F.lit(1)).alias("customers"))
        .select(
            *by, "repeat_customers", round_half_up(divide_or_zero("repeat_customers", "customers"), 6).alias("repeat_rate")
        )
    )


def segment_measures(lines: DataFrame, rfm: DataFrame, by: list[str]) -> DataFrame:
    """Sales and profit of the Champions and At Risk customers.

    Lines are summed per customer before they meet the segmentation, so the join sees one row per
    customer and group.
    """
    spend = lines.groupBy(*by, "customer_id").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    joined = spend.join(rfm.select("customer_id", "rfm_segment"), "customer_id")

    def part(segment: str, value: str):
        total = money(F.sum(F.when(F.col("rfm_segment") == segment, F.col(value))))
        return F.coalesce(total, F.lit(0.0))

    return joined.groupBy(*by).agg(
        part("Champions", "sales").alias("champions_sales"),
        part("At Risk", "sales").alias("at_risk_sales"),
        part("At Risk", "profit").alias("at_risk_profit"),
    )


def top_product_sales(lines: DataFrame, by: list[str]) -> DataFrame:
    return (
        lines.groupBy(*by, "product_name")
        .agg(F.sum("sales").alias("sales"))
        .groupBy(*by)
        .agg(money(F.max("sales")).alias("top_product_sales"))
    )


def on_time_rate(star: StarTables, by: list[str]) -> DataFrame:
    """Lines shipped within the service target of their shipping mode."""
    targets = star.shipping.select("ship_mode_id", "sla_target_days")
    in_time = F.count_if(F.col("sla_target_days") >= F.col("shipping_days"))
    return (
        star.fact.join(targets, "ship_mode_id", "left")
        .groupBy(*by)
        .agg(round_half_up(divide_or_zero(in_time, F.count(F.lit(1))), 6).alias("on_time_rate"))
    )


def monthly_time_intelligence(lines: DataFrame) -> DataFrame:
    """Year to date, last year and growth per month. All windows run over calendar months."""
    months = (
        lines.groupBy("year", "month", "year_month")
        .agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
        .withColumn("month_index", F.col("year") * 12 + F.col("month"))
    )
    in_year = Window.partitionBy("year").orderBy("month")
    a_year_ago = Window.orderBy("month_index").rangeBetween(-12, -12)
    looked = months.withColumn("sales_before", F.max("sales").over(a_year_ago)).withColumn(
        "profit_before", F.max("profit").over(a_year_ago)
    )

    def growth(value: str):
        return round_half_up(divide_or_zero(F.col(value) - F.col(f"{value}_before"), f"{value}_before"), 6)

    return looked.select(
        "year_month",
        money("sales").alias("total_sales"),
        money("profit").alias("total_profit"),
        money(F.sum("sales").over(in_year)).alias("sales_ytd"),
        money(F.sum("profit").over(in_year)).alias("profit_ytd"),
        money("sales_before").alias("sales_ly"),
        money("profit_before").alias("profit_ly"),
        # A missing last year counts as zero in a difference.
        money(F.col("sales") - F.coalesce("sales_before", F.lit(0))).alias("sales_yoy_amt"),
        growth("sales").alias("sales_yoy_pct"),
        growth("profit").alias("profit_yoy_pct"),
    ).orderBy("year_month")


def sales_mtd(lines: DataFrame) -> DataFrame:
    days = lines.groupBy("order_date", "year_month").agg(F.sum("sales").alias("sales"))
    in_month = Window.partitionBy("year_month").orderBy("order_date")
    return days.select(
        "order_date",
        money("sales").alias("total_sales"),
        money(F.sum("sales").over(in_month)).alias("sales_mtd"),
    ).orderBy("order_date")


def sales_3m_average(lines: DataFrame, calendar: DataFrame) -> DataFrame:
    """Two readings of a three-month average per month.

    ``sales_3m_daily_avg`` is the mean of daily totals, over days with sales, in the three months
    that end on the month's last calendar day. ``sales_3m_monthly_avg`` is the mean of the last
    three monthly totals. A day is offered to the four months it could count in, so months and days
    meet by key.
    """
    days = lines.groupBy("order_date").agg(F.sum("sales").alias("sales"))
    ends = calendar.groupBy("year_month").agg(F.max("date").alias("last_date"))
    offered = days.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "year_month", F.date_format(F.add_months(F.trunc("order_date", "month"), F.col("ahead")), "yyyy-MM")
    )
    in_window = (F.col("order_date") <= F.col("last_date")) & (
        F.col("order_date") > F.add_months("last_date", F.lit(-3))
    )
    daily = (
        offered.join(ends, "year_month")
        .filter(in_window)
        .groupBy("year_month")
        .agg(round_half_up(divide_or_zero(F.sum("sales"), F.count(F.lit(1))), 2).alias("sales_3m_daily_avg"))
    )
    last_three = Window.orderBy("year_month").rowsBetween(-2, 0)  # one row per calendar month
    monthly = (
        days.groupBy(F.date_format("order_date", "yyyy-MM").alias("year_month"))
        .agg(F.sum("sales").alias("sales"))
        .select(
            "year_month",
            round_half_up(
                divide_or_zero(F.sum("sales").over(last_three), F.count(F.lit(1)).over(last_three)), 2
            ).alias("sales_3m_monthly_avg"),
        )
    )
    return daily.join(monthly, "year_month", "left").orderBy("year_month")


def measure_reconcile(star: StarTables) -> DataFrame:
    names = {
        "total_sales": "total_sales",
        "total_profit": "total_profit",
        "total_quantity": "total_quantity",
        "total_orders": "total_orders",
        "total_customers": "total_customers",
        "average_order_value": "aov",
        "loss_making_sales": "loss_sales",
        "loss_amount": "unprofitable_loss",
    }
    percent = {"profit_margin_pct": "profit_margin", "average_discount_pct": "avg_discount_simple"}
    return star.fact.agg(
        *[LINE_MEASURES[measure]().alias(name) for name, measure in names.items()],
        *[round_half_up(LINE_MEASURES[measure]() * 100, 2).alias(name) for name, measure in percent.items()],
        round_half_up(LINE_MEASURES["avg_ship_days"](), 2).alias("average_shipping_days"),
    )
