"""Business questions on the star schema. Dimensions supply the names, facts supply the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.expr import growth_pct, mean, money, ntile_bin, pct, ratio, round_half_up
from tallyworks.operators.ranking import top_by_dense_rank, with_position
from tallyworks.plans import flat_suite
from tallyworks.plans.star import StarTables

# Labels and upper bounds of the discount brackets.
DISCOUNT_BRACKETS = [
    ("No Discount (0%)", "0"),
    ("Low Discount (1-20%)", "0.20"),
    ("Medium Discount (21-50%)", "0.50"),
]
TOP_DISCOUNT_BRACKET = "High Discount (>50%)"


def _with_product(star: StarTables) -> DataFrame:
    return star.fact.join(star.product, "product_id")


def _with_geography(star: StarTables) -> DataFrame:
    return star.fact.join(star.geography, "postal_code")


def _with_customer(star: StarTables) -> DataFrame:
    return star.fact.join(star.customer, "customer_id")


def _margin():
    return pct("profit_sum", "sales_sum").alias("profit_margin_pct")


def star_kpis(star: StarTables) -> DataFrame:
    totals = star.fact.agg(
        *flat_suite.sums(),
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_units_sold"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )
    return totals.select(
        money("sales_sum").alias("total_revenue"),
        money("profit_sum").alias("total_profit"),
        _margin(),
        "total_orders",
        "total_units_sold",
        "unique_customers",
        round_half_up(ratio("sales_sum", "total_orders"), 2).alias("average_order_value"),
    )


def star_yoy(star: StarTables) -> DataFrame:
    years = (
        star.fact.groupBy(F.date_format("order_date", "yyyy").alias("order_year"))
        .agg(
            money(F.sum("sales")).alias("total_sales"),
            money(F.sum("profit")).alias("total_profit"),
            F.count_distinct("order_id").alias("total_orders"),
        )
    )
    before = Window.orderBy("order_year")  # a handful of years
    return (
        years.withColumn("prior_year_sales", F.lag("total_sales").over(before))
        .withColumn("prior_year_profit", F.lag("total_profit").over(before))
        .withColumn("yoy_sales_growth_pct", growth_pct("total_sales", "prior_year_sales"))
        .withColumn("yoy_profit_growth_pct", growth_pct("total_profit", "prior_year_profit"))
        .orderBy("order_year")
    )


def star_rolling_3m(star: StarTables) -> DataFrame:
    last_three = Window.orderBy("year_month").rowsBetween(-2, 0)  # one row per calendar month
    return (
        star.fact.groupBy(F.date_format("order_date", "yyyy-MM").alias("year_month"))
        .agg(money(F.sum("sales")).alias("monthly_revenue"), money(F.sum("profit")).alias("monthly_profit"))
        .withColumn("rolling_3m_avg_revenue", round_half_up(F.avg("monthly_revenue").over(last_three), 2))
        .orderBy("year_month")
    )


def star_running_totals(star: StarTables) -> DataFrame:
    so_far = Window.orderBy("year_month")  # one row per calendar month
    return (
        star.fact.groupBy(F.date_format("order_date", "yyyy-MM").alias("year_month"))
        .agg(*flat_suite.sums())
        .select(
            "year_month",
            money("sales_sum").alias("monthly_sales"),
            money(F.sum("sales_sum").over(so_far)).alias("cumulative_sales"),
            money("profit_sum").alias("monthly_profit"),
            money(F.sum("profit_sum").over(so_far)).alias("cumulative_profit"),
        )
        .orderBy("year_month")
    )


def star_category_matrix(star: StarTables) -> DataFrame:
    return (
        flat_suite.orders_and_sums(
            _with_product(star), ["category", "sub_category"], F.sum("quantity").alias("units_sold")
        )
        .select(
            "category",
            "sub_category",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            "units_sold",
            F.col("orders").alias("total_orders"),
        )
        .orderBy("category", F.col("total_profit").desc(), "sub_category")
    )


def star_subcategory_share(star: StarTables) -> DataFrame:
    return flat_suite.subcategory_share(_with_product(star)).withColumnRenamed(
        "subcat_share_pct", "category_share_pct"
    )


PRODUCT = ["product_id", "product_name", "category", "sub_category"]


def star_top_products(star: StarTables, k: int = 10) -> DataFrame:
    # Names join after the sums, so the fact is reduced to one row per product first.
    totals = star.fact.groupBy("product_id").agg(*flat_suite.sums())
    return (
        top_by_dense_rank(totals, "sales_sum", k, "revenue_rank")
        .join(star.product, "product_id")
        .select(
            *PRODUCT, money("sales_sum").alias("total_sales"), money("profit_sum").alias("total_profit"), "revenue_rank"
        )
        .orderBy("revenue_rank", "product_id")
    )


def star_loss_products(star: StarTables, k: int = 10) -> DataFrame:
    return (
        star.fact.groupBy("product_id")
        .agg(*flat_suite.sums(), mean("discount").alias("discount_mean"), F.count(F.lit(1)).alias("transaction_count"))
        .filter(F.col("profit_sum") < 0)
        .join(star.product, "product_id")
        .select(
            *PRODUCT,
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_loss"),
            round_half_up(F.col("discount_mean") * 100, 1).alias("avg_discount_pct"),
            "transaction_count",
        )
        .orderBy("total_loss", "product_id")
        .limit(k)
    )


def discount_bracket_tiers(star: StarTables) -> DataFrame:
    label, place = flat_suite.band_of(F.col("discount"), DISCOUNT_BRACKETS, TOP_DISCOUNT_BRACKET)
    return (
        star.fact.groupBy(label.alias("discount_bracket"), place.alias("place"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), *flat_suite.sums(), mean("discount").alias("discount_mean"))
        .orderBy("place")
        .select(
            "discount_bracket",
            "transaction_count",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            round_half_up(F.col("discount_mean") * 100, 2).alias("avg_discount_pct"),
        )
    )


def deep_discount_audit(star: StarTables, threshold: str = "0.50") -> DataFrame:
    return (
        _with_product(star)
        .filter(F.col("discount") > F.lit(threshold).cast("decimal(7,4)"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("deep_discount_orders"), *flat_suite.sums(), mean("discount").alias("discount_mean"))
        .select(
            "category",
            "deep_discount_orders",
            money("sales_sum").alias("deep_discount_sales"),
            money("profit_sum").alias("total_loss_incurred"),
            round_half_up(F.col("discount_mean") * 100, 1).alias("avg_discount_given"),
        )
        .orderBy("total_loss_incurred", "category")
    )


def star_region_rank(star: StarTables) -> DataFrame:
    best = Window.orderBy(F.col("profit_sum").desc())  # one row per region
    return (
        flat_suite.orders_and_sums(_with_geography(star), ["region"])
        .withColumn("profit_rank", F.dense_rank().over(best))
        .select(
            "region",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            F.col("orders").alias("order_count"),
            "profit_rank",
        )
        .orderBy("profit_rank", "region")
    )


def star_loss_states(star: StarTables, k: int = 10) -> DataFrame:
    return (
        flat_suite.orders_and_sums(_with_geography(star), ["state", "region"], mean("discount").alias("discount_mean"))
        .filter(F.col("profit_sum") < 0)
        .select(
            "state",
            "region",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("net_profit"),
            _margin(),
            round_half_up(F.col("discount_mean") * 100, 1).alias("avg_discount_pct"),
            F.col("orders").alias("total_orders"),
        )
        .orderBy("net_profit", "state", "region")
        .limit(k)
    )


def top_cities(star: StarTables, k: int = 10) -> DataFrame:
    return (
        flat_suite.orders_and_sums(_with_geography(star), ["city", "state", "region"])
        .select(
            "city",
            "state",
            "region",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            pct("profit_sum", "sales_sum").alias("margin_pct"),
            F.col("orders").alias("order_count"),
        )
        .orderBy(F.col("total_profit").desc(), "city", "state", "region")
        .limit(k)
    )


def customer_ltv(star: StarTables, k: int = 15) -> DataFrame:
    totals = flat_suite.orders_and_sums(
        star.fact, ["customer_id"], F.sum("quantity").alias("total_units_bought")
    )
    return (
        totals.join(star.customer, "customer_id")
        .select(
            "customer_id",
            "customer_name",
            "segment",
            F.col("orders").alias("total_orders"),
            "total_units_bought",
            money("sales_sum").alias("lifetime_spend"),
            money("profit_sum").alias("lifetime_profit"),
            round_half_up(ratio("sales_sum", "orders"), 2).alias("avg_order_value"),
        )
        .orderBy(F.col("lifetime_spend").desc(), "customer_id")
        .limit(k)
    )


def rfm_ntile(star: StarTables, k: int = 15) -> DataFrame:
    """NTILE(5) scores of all customers; the ``k`` biggest spenders are returned."""
    raw = (
        star.fact.groupBy("customer_id")
        .agg(
            F.max("order_date").alias("last_order"),
            F.count_distinct("order_id").alias("frequency_orders"),
            F.sum("sales").alias("monetary"),
        )
    )
    key = F.col("customer_id")
    scored = with_position(raw, [F.col("last_order"), key], "r_place", total="customers")
    scored = with_position(scored, [F.col("frequency_orders"), key], "f_place")
    scored = with_position(scored, [F.col("monetary"), key], "m_place")
    reference = scored.agg(F.max("last_order")).scalar()
    return (
        scored.select(
            "customer_id",
            F.datediff(reference, "last_order").alias("recency_days"),
            "frequency_orders",
            money("monetary").alias("monetary_value"),
            *[ntile_bin(f"{x}_place", "customers", 5).alias(f"{x}_score") for x in "rfm"],
        )
        .withColumn("rfm_cell", F.concat("r_score", "f_score", "m_score"))
        .orderBy(F.col("monetary_value").desc(), "customer_id")
        .limit(k)
    )


def star_pareto(star: StarTables) -> DataFrame:
    return (
        flat_suite.pareto_points(star.fact, ["0.10", "0.20", "0.50", "0.80"])
        .select(
            "customer_rank",
            pct("customer_rank", "total").alias("customer_percentile"),
            money("value").alias("customer_spend"),
            pct("amount_down_to", "amount_total").alias("cumulative_revenue_pct"),
        )
        .orderBy("customer_rank")
    )


def star_segment_performance(star: StarTables) -> DataFrame:
    return (
        flat_suite.orders_and_sums(
            _with_customer(star), ["segment"], F.count_distinct("customer_id").alias("customer_count")
        )
        .select(
            "segment",
            "customer_count",
            F.col("orders").alias("total_orders"),
            money("sales_sum").alias("total_revenue"),
            money("profit_sum").alias("total_profit"),
            _margin(),
            round_half_up(ratio("sales_sum", "orders"), 2).alias("average_order_value"),
        )
        .orderBy(F.col("total_revenue").desc(), "segment")
    )


def star_buyer_cohorts(star: StarTables) -> DataFrame:
    return flat_suite.buyer_cohorts(star.fact, share="pct_of_customers")


def star_ship_modes(star: StarTables) -> DataFrame:
    return flat_suite.ship_mode_performance(star.fact).withColumnRenamed("total_orders", "order_count")


def delivery_delay(star: StarTables, days: int = 5) -> DataFrame:
    """Late LINES over distinct ORDERS, so the share can exceed 100 percent."""
    return (
        star.fact.groupBy("ship_mode")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.sum((F.col("shipping_days") > days).cast("int")).alias(f"delayed_orders_gt_{days}d"),
        )
        .withColumn("pct_delayed", pct(f"delayed_orders_gt_{days}d", "total_orders"))
        .orderBy(F.col("pct_delayed").desc(), "ship_mode")
    )


def basket_pairs(star: StarTables, k: int = 10) -> DataFrame:
    """Sub-category pairs that occur in the same order most often.

    Each order becomes its sorted set of distinct sub-categories, at most as long as the catalogue
    of sub-categories however many lines the order has. Orders with equal sets are counted together,
    so a set is paired once and weighted; there is no self-join and nothing but (pair, count) moves.
    """
    baskets = (
        _with_product(star)
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_set("sub_category")).alias("basket"))
        .filter(F.size("basket") > 1)
        .groupBy("basket")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    first = baskets.select("orders", "basket", F.posexplode("basket").alias("place", "subcat_a"))
    after = F.expr("slice(basket, place + 2, size(basket))")
    return (
        first.select("orders", "subcat_a", F.explode(after).alias("subcat_b"))
        .groupBy("subcat_a", "subcat_b")
        .agg(F.sum("orders").alias("times_bought_together"))
        .orderBy(F.col("times_bought_together").desc(), "subcat_a", "subcat_b")
        .limit(k)
    )


def acquisition_cohorts(star: StarTables) -> DataFrame:
    """Customers by year of first purchase. One pass: totals per customer carry the first year."""
    return (
        star.fact.groupBy("customer_id")
        .agg(F.date_format(F.min("order_date"), "yyyy").alias("cohort_year"), *flat_suite.sums())
        .groupBy("cohort_year")
        .agg(
            F.count(F.lit(1)).alias("new_customers_acquired"),
            F.sum("sales_sum").alias("revenue"),
            F.sum("profit_sum").alias("profit"),
        )
        .select(
            "cohort_year",
            "new_customers_acquired",
            money("revenue").alias("total_cohort_revenue"),
            money("profit").alias("total_cohort_profit"),
            round_half_up(ratio("revenue", "new_customers_acquired"), 2).alias("revenue_per_acquired_customer"),
        )
        .orderBy("cohort_year")
    )
