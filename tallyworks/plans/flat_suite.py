"""Business questions on the flat order-line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.expr import growth_pct, labelled, mean, money, pct, ratio, round_half_up
from tallyworks.operators.ranking import from_the_top, top_by_dense_rank, top_by_rank, value_histogram

PRODUCT = ["product_name", "category", "sub_category"]
CUSTOMER = ["customer_id", "customer_name", "segment"]

# Labels and upper bounds of the gap-free discount bands.
DISCOUNT_BANDS = [
    ("0%", "0"),
    (">0%-10%", "0.10"),
    (">10%-20%", "0.20"),
    (">20%-30%", "0.30"),
    (">30%-40%", "0.40"),
]
TOP_DISCOUNT_BAND = ">40%"

# Order-count cohorts as (label, highest count).
BUYER_COHORTS = [
    ("1 Order (One-Time Buyer)", 1),
    ("2-4 Orders (Occasional)", 4),
    ("5-9 Orders (Frequent)", 9),
]
TOP_BUYER_COHORT = "10+ Orders (Power Buyer)"


def _margin(sales: str = "sales_sum", profit: str = "profit_sum") -> Column:
    return pct(profit, sales).alias("profit_margin_pct")


def sums() -> list[Column]:
    return [F.sum("sales").alias("sales_sum"), F.sum("profit").alias("profit_sum")]


def orders_and_sums(lines: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count_distinct("order_id").alias("orders"), *sums(), *extra)


def core_kpis(lines: DataFrame) -> DataFrame:
    totals = lines.agg(
        *sums(),
        F.sum("quantity").alias("total_quantity_sold"),
        F.count_distinct("order_id").alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
        mean("discount").alias("discount_mean"),
        mean("shipping_days").alias("days_mean"),
    )
    return totals.select(
        money("sales_sum").alias("total_sales"),
        money("profit_sum").alias("total_profit"),
        "total_quantity_sold",
        "total_orders",
        "unique_customers",
        round_half_up(ratio("sales_sum", "total_orders"), 2).alias("average_order_value"),
        _margin(),
        round_half_up(F.col("discount_mean") * 100, 2).alias("average_discount_pct"),
        round_half_up("days_mean", 2).alias("average_shipping_days"),
    )


def sales_profit_by_year(lines: DataFrame) -> DataFrame:
    return (
        orders_and_sums(lines, ["year"], F.sum("quantity").alias("units_sold"))
        .select(
            "year",
            F.col("orders").alias("total_orders"),
            "units_sold",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
        )
        .orderBy("year")
    )


def yoy_growth(lines: DataFrame) -> DataFrame:
    years = lines.groupBy("year").agg(
        money(F.sum("sales")).alias("annual_sales"), money(F.sum("profit")).alias("annual_profit")
    )
    before = Window.orderBy("year")  # a handful of years
    return (
        years.withColumn("prior_year_sales", F.lag("annual_sales").over(before))
        .withColumn("prior_year_profit", F.lag("annual_profit").over(before))
        .select(
            "year",
            "annual_sales",
            "prior_year_sales",
            growth_pct("annual_sales", "prior_year_sales").alias("yoy_sales_growth_pct"),
            "annual_profit",
            "prior_year_profit",
            growth_pct("annual_profit", "prior_year_profit").alias("yoy_profit_growth_pct"),
        )
        .orderBy("year")
    )


def monthly_sales_trend(lines: DataFrame) -> DataFrame:
    return (
        orders_and_sums(lines, ["year_month", "year", "month"])
        .select(
            "year_month",
            "year",
            "month",
            F.col("orders").alias("total_orders"),
            money("sales_sum").alias("monthly_sales"),
            money("profit_sum").alias("monthly_profit"),
            _margin(),
        )
        .orderBy("year_month")
    )


def quarterly_performance(lines: DataFrame) -> DataFrame:
    return (
        orders_and_sums(lines, ["year", "quarter"])
        .select(
            "year",
            "quarter",
            F.col("orders").alias("order_count"),
            money("sales_sum").alias("quarterly_sales"),
            money("profit_sum").alias("quarterly_profit"),
            _margin(),
        )
        .orderBy("year", "quarter")
    )


def seasonality_by_month(lines: DataFrame) -> DataFrame:
    return (
        orders_and_sums(lines, ["month", "month_name"])
        .select(
            F.col("month").alias("month_number"),
            F.col("month_name").alias("month"),
            F.col("orders").alias("total_orders"),
            money("sales_sum").alias("cumulative_sales"),
            money("profit_sum").alias("cumulative_profit"),
            _margin(),
        )
        .orderBy("month_number")
    )


def category_performance(lines: DataFrame) -> DataFrame:
    everything = Window.partitionBy()  # one row per category
    return (
        orders_and_sums(lines, ["category"], F.sum("quantity").alias("units_sold"))
        .withColumn("all_sales", F.sum("sales_sum").over(everything))
        .withColumn("all_profit", F.sum("profit_sum").over(everything))
        .select(
            "category",
            F.col("orders").alias("total_orders"),
            "units_sold",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            pct("sales_sum", "all_sales").alias("revenue_share_pct"),
            pct("profit_sum", "all_profit").alias("profit_share_pct"),
        )
        .orderBy(F.col("total_sales").desc(), "category")
    )


def subcategory_performance(lines: DataFrame) -> DataFrame:
    best = Window.orderBy(F.col("profit_sum").desc())  # one row per sub-category
    return (
        orders_and_sums(lines, ["category", "sub_category"], F.sum("quantity").alias("units_sold"))
        .withColumn("profit_rank", F.dense_rank().over(best))
        .select(
            "category",
            "sub_category",
            F.col("orders").alias("total_orders"),
            "units_sold",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            "profit_rank",
        )
        .orderBy(F.col("total_profit").desc(), "category", "sub_category")
    )


def _product_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PRODUCT).agg(F.sum("quantity").alias("total_quantity"), *sums())


def _ranked_products(totals: DataFrame, value: str, rank: str, k: int) -> DataFrame:
    return (
        top_by_dense_rank(totals, value, k, rank)
        .select(
            *PRODUCT,
            "total_quantity",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            rank,
        )
        .orderBy(rank, *PRODUCT)
    )


def top_products_by_sales(lines: DataFrame, k: int = 10) -> DataFrame:
    return _ranked_products(_product_totals(lines), "sales_sum", "sales_rank", k)


def top_products_by_profit(lines: DataFrame, k: int = 10) -> DataFrame:
    return _ranked_products(_product_totals(lines), "profit_sum", "profit_rank", k)


def bottom_products(lines: DataFrame, k: int = 10) -> DataFrame:
    losing = (
        lines.groupBy(*PRODUCT)
        .agg(F.sum("quantity").alias("total_quantity"), *sums(), mean("discount").alias("discount_mean"))
        .filter(F.col("profit_sum") < 0)
    )
    return (
        top_by_dense_rank(losing, "profit_sum", k, "loss_rank", ascending=True)
        .select(
            *PRODUCT,
            "total_quantity",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_loss"),
            round_half_up(F.col("discount_mean") * 100, 2).alias("avg_discount_pct"),
            _margin(),
            "loss_rank",
        )
        .orderBy("loss_rank", *PRODUCT)
    )


def high_sales_negative_profit(lines: DataFrame, floor: int = 3000) -> DataFrame:
    return (
        lines.groupBy(*PRODUCT)
        .agg(*sums(), mean("discount").alias("discount_mean"), F.count(F.lit(1)).alias("transaction_count"))
        .filter((F.col("sales_sum") > floor) & (F.col("profit_sum") < 0))
        .select(
            *PRODUCT,
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_loss"),
            round_half_up(F.col("discount_mean") * 100, 2).alias("avg_discount_pct"),
            _margin(),
            "transaction_count",
        )
        .orderBy("total_loss", *PRODUCT)
    )


def top_customers_by_sales(lines: DataFrame, k: int = 10) -> DataFrame:
    totals = orders_and_sums(lines, CUSTOMER, F.sum("quantity").alias("units_purchased"))
    return (
        top_by_rank(totals, "sales_sum", k, "sales_rank")
        .select(
            *CUSTOMER,
            F.col("orders").alias("total_orders"),
            "units_purchased",
            money("sales_sum").alias("total_spend"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            "sales_rank",
        )
        .orderBy("sales_rank", "customer_id")
    )


def top_customers_by_profit(lines: DataFrame, k: int = 10) -> DataFrame:
    return (
        top_by_rank(orders_and_sums(lines, CUSTOMER), "profit_sum", k, "profit_rank")
        .select(
            *CUSTOMER,
            F.col("orders").alias("total_orders"),
            money("sales_sum").alias("total_spend"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            "profit_rank",
        )
        .orderBy("profit_rank", "customer_id")
    )


def pareto_points(lines: DataFrame, shares: list[str]) -> DataFrame:
    """Customers at the given shares of the spend ranking, and at its end.

    The running total includes customers with equal spend, as a default window frame does.
    """
    spend = lines.groupBy("customer_id").agg(F.sum("sales").alias("spend"))
    ranks = [F.floor(F.col("total") * F.lit(share).cast("decimal(5,4)")).cast("bigint") for share in shares]
    wanted = F.array_distinct(F.array(*ranks, F.col("total")))
    return (
        from_the_top(value_histogram(spend, ["spend"]))
        .withColumn("wanted", F.filter(wanted, lambda rank: (rank >= F.col("best")) & (rank <= F.col("worst"))))
        .filter(F.size("wanted") > 0)
        .select(F.explode("wanted").alias("customer_rank"), "total", "value", "amount_down_to", "amount_total")
    )


def customer_pareto(lines: DataFrame) -> DataFrame:
    return (
        pareto_points(lines, ["0.05", "0.10", "0.20", "0.50"])
        .select(
            "customer_rank",
            pct("customer_rank", "total").alias("customer_percentile"),
            money("value").alias("customer_spend"),
            money("amount_down_to").alias("cumulative_sales"),
            pct("amount_down_to", "amount_total").alias("cumulative_revenue_share_pct"),
        )
        .orderBy("customer_rank")
    )


def regional_performance(lines: DataFrame) -> DataFrame:
    best = Window.orderBy(F.col("profit_sum").desc())  # one row per region
    return (
        orders_and_sums(lines, ["region"], F.sum("quantity").alias("units_sold"))
        .withColumn("profit_rank", F.dense_rank().over(best))
        .select(
            "region",
            F.col("orders").alias("total_orders"),
            "units_sold",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            "profit_rank",
        )
        .orderBy("profit_rank", "region")
    )


def _state_totals(lines: DataFrame) -> DataFrame:
    return orders_and_sums(lines, ["state", "region"], mean("discount").alias("discount_mean"))


def state_profitability_ranking(lines: DataFrame, k: int = 5) -> DataFrame:
    best = Window.orderBy(F.col("profit_sum").desc(), "state", "region")  # one row per state
    worst = Window.orderBy("profit_sum", "state", "region")
    return (
        _state_totals(lines)
        .withColumn("from_top", F.row_number().over(best))
        .withColumn("from_bottom", F.row_number().over(worst))
        .withColumn(
            "state_group",
            F.when(F.col("from_top") <= k, f"Top {k} Profitable").when(F.col("from_bottom") <= k, f"Bottom {k} Deficit"),
        )
        .filter(F.col("state_group").isNotNull())
        .select(
            "state",
            "region",
            F.col("orders").alias("order_count"),
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            round_half_up(F.col("discount_mean") * 100, 2).alias("avg_discount_pct"),
            "state_group",
        )
        .orderBy(F.col("total_profit").desc(), "state")
    )


def segment_performance(lines: DataFrame) -> DataFrame:
    return (
        orders_and_sums(
            lines,
            ["segment"],
            F.count_distinct("customer_id").alias("unique_customers"),
            F.sum("quantity").alias("units_sold"),
        )
        .select(
            "segment",
            "unique_customers",
            F.col("orders").alias("total_orders"),
            "units_sold",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            round_half_up(ratio("sales_sum", "orders"), 2).alias("average_order_value"),
        )
        .orderBy(F.col("total_sales").desc(), "segment")
    )


def ship_mode_performance(lines: DataFrame) -> DataFrame:
    return (
        orders_and_sums(
            lines,
            ["ship_mode"],
            mean("shipping_days").alias("days_mean"),
            F.min("shipping_days").alias("min_shipping_days"),
            F.max("shipping_days").alias("max_shipping_days"),
        )
        .select(
            "ship_mode",
            F.col("orders").alias("total_orders"),
            round_half_up("days_mean", 2).alias("avg_shipping_days"),
            "min_shipping_days",
            "max_shipping_days",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
        )
        .orderBy("avg_shipping_days", "ship_mode")
    )


def band_of(discount: Column, bands: list[tuple[str, str]], top: str) -> tuple[Column, Column]:
    """Label and sort key of the first band whose upper bound is not exceeded; missing and negative ones are Other."""
    neither = discount.isNull() | (discount < 0)
    bound = [(discount <= F.lit(upper).cast("decimal(7,4)"), label) for label, upper in bands]
    label = labelled([(neither, F.lit("Other"))] + [(condition, F.lit(name)) for condition, name in bound], F.lit(top))
    places = [(condition, F.lit(i)) for i, (condition, _) in enumerate(bound, 1)]
    place = labelled([(neither, F.lit(len(bands) + 2)), *places], F.lit(len(bands) + 1))
    return label, place


def discount_bands(lines: DataFrame) -> DataFrame:
    label, place = band_of(F.col("discount"), DISCOUNT_BANDS, TOP_DISCOUNT_BAND)
    return (
        lines.groupBy(label.alias("discount_band"), place.alias("place"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), *sums(), mean("discount").alias("discount_mean"))
        .orderBy("place")
        .select(
            "discount_band",
            "transaction_count",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            round_half_up(F.col("discount_mean") * 100, 2).alias("avg_discount_pct"),
        )
    )


def running_totals(lines: DataFrame) -> DataFrame:
    months = lines.groupBy("year_month").agg(*sums())
    so_far = Window.orderBy("year_month")  # one row per calendar month
    return months.select(
        "year_month",
        money("sales_sum").alias("monthly_sales"),
        money(F.sum("sales_sum").over(so_far)).alias("running_total_sales"),
        money("profit_sum").alias("monthly_profit"),
        money(F.sum("profit_sum").over(so_far)).alias("running_total_profit"),
    ).orderBy("year_month")


def subcategory_share(lines: DataFrame) -> DataFrame:
    parent = Window.partitionBy("category")
    return (
        lines.groupBy("category", "sub_category")
        .agg(F.sum("sales").alias("sales_sum"))
        .withColumn("category_sum", F.sum("sales_sum").over(parent))
        .select(
            "category",
            "sub_category",
            money("sales_sum").alias("subcat_sales"),
            money("category_sum").alias("category_total_sales"),
            pct("sales_sum", "category_sum").alias("subcat_share_pct"),
        )
        .orderBy("category", F.col("subcat_share_pct").desc(), "sub_category")
    )


def buyer_cohorts(lines: DataFrame, share: str = "customer_pct") -> DataFrame:
    orders = F.col("order_frequency")
    cohort = labelled([(orders <= most, F.lit(label)) for label, most in BUYER_COHORTS], F.lit(TOP_BUYER_COHORT))
    return (
        lines.groupBy("customer_id")
        .agg(F.count_distinct("order_id").alias("order_frequency"))
        .groupBy(cohort.alias("buyer_cohort"))
        .agg(F.count("customer_id").alias("customer_count"))
        .select(
            "buyer_cohort",
            "customer_count",
            pct("customer_count", F.sum("customer_count").over(Window.partitionBy())).alias(share),
        )
        .orderBy(F.col("customer_count").desc(), "buyer_cohort")
    )


def rolling_3m_average(lines: DataFrame) -> DataFrame:
    last_three = Window.orderBy("year_month").rowsBetween(-2, 0)  # one row per calendar month
    return (
        lines.groupBy("year_month")
        .agg(money(F.sum("sales")).alias("monthly_sales"))
        .select(
            "year_month",
            "monthly_sales",
            round_half_up(F.avg("monthly_sales").over(last_three), 2).alias("rolling_3m_avg_sales"),
        )
        .orderBy("year_month")
    )


def loss_making_states(lines: DataFrame) -> DataFrame:
    return (
        _state_totals(lines)
        .filter(F.col("profit_sum") < 0)
        .select(
            "state",
            "region",
            F.col("orders").alias("total_orders"),
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("net_profit_loss"),
            _margin(),
            round_half_up(F.col("discount_mean") * 100, 2).alias("avg_discount_pct"),
        )
        .orderBy("net_profit_loss", "state")
    )
