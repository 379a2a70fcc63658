"""Parametrised reports. Each takes order lines and a filter context.

Ratios are zero when there is nothing to divide by, and shares and margins start from money that is
already rounded to cents, as the reports have always been published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.expr import (
    guarded_pct,
    guarded_ratio,
    labelled,
    mean,
    money,
    quantile_bin,
    ratio,
    round_half_even,
    round_scaled,
    whole,
)
from tallyworks.operators.filters import EVERYTHING, FilterContext, contains_any
from tallyworks.operators.grain import per_order
from tallyworks.operators.ranking import amount_of_top, from_the_top, ranges_of_values, value_histogram, with_position

# Discount bands as published, with their gaps.
GAPPED_BANDS = [
    ("No Discount (0%)", 0.0, 0.0),
    ("Low (1% - 10%)", 0.001, 0.10),
    ("Moderate (11% - 20%)", 0.101, 0.20),
    ("High (21% - 30%)", 0.201, 0.30),
    ("Aggressive (31% - 50%)", 0.301, 0.50),
    ("Severe (> 50%)", 0.501, 1.00),
]

LEDGER_SORTS = ["order_date", "sales", "profit", "quantity", "customer_name", "country"]


def _zeroed_money(total) -> Column:
    return F.coalesce(money(total), F.lit(0.0))


def _rounded_sums() -> list[Column]:
    return [_zeroed_money(F.sum("sales")).alias("revenue"), _zeroed_money(F.sum("profit")).alias("profit")]


def _margin() -> Column:
    return guarded_pct("profit", "revenue").alias("profit_margin")


def kpi_summary(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """Fourteen figures in one pass. Profitable and loss orders are decided per line, so an order can be both."""
    chosen = filters.apply(lines).withColumns(
        {
            "returned_sales": F.when(F.col("is_returned"), F.col("sales")),
            "discount_known": F.col("discount").isNotNull().cast("int"),
            "cost_known": F.col("shipping_cost").isNotNull().cast("int"),
        }
    )
    summed = ("sales", "profit", "quantity", "discount", "shipping_cost", "returned_sales", "discount_known", "cost_known")
    orders = per_order(
        chosen,
        [],
        {c: c for c in summed},
        {"returned": F.col("is_returned"), "gaining": F.col("profit") > 0, "losing": F.col("profit") <= 0},
    ).agg(
        *[F.sum(c).alias(c) for c in (*summed, "returned", "gaining", "losing")],
        F.count(F.lit(1)).alias("orders"),
    )
    customers = chosen.agg(F.count_distinct("customer_id")).scalar()
    return orders.select(
        _zeroed_money("sales").alias("total_revenue"),
        _zeroed_money("profit").alias("total_profit"),
        guarded_pct("profit", "sales").alias("profit_margin"),
        F.col("orders").alias("total_orders"),
        whole("quantity").alias("units_sold"),
        customers.alias("total_customers"),
        guarded_ratio("sales", "orders").alias("avg_order_value"),
        whole("returned").alias("total_returned_orders"),
        guarded_pct("returned", "orders").alias("return_rate"),
        _zeroed_money("returned_sales").alias("returned_revenue"),
        whole("gaining").alias("profitable_orders"),
        whole("losing").alias("loss_orders"),
        F.coalesce(round_half_even(ratio("discount", "discount_known") * 100, 2), F.lit(0.0)).alias("avg_discount"),
        F.coalesce(round_half_even(ratio("shipping_cost", "cost_known"), 2), F.lit(0.0)).alias("avg_shipping_cost"),
    )


def sales_trend(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """Monthly revenue with rolling mean, running total and growth over the same month last year.

    Last year's month is found by its number, so a missing month gives no growth instead of a shifted one.
    """
    months = (
        filters.apply(lines)
        .groupBy("year_month", "year", "month", "month_name", "quarter")
        .agg(
            money(F.sum("sales")).alias("revenue"),
            F.count_distinct("order_id").alias("orders"),
            F.sum("quantity").alias("units"),
        )
    )
    months = months.withColumn("month_index", F.col("year") * 12 + F.col("month"))
    in_order = Window.orderBy("month_index")  # one row per calendar month
    return (
        months.withColumn("previous", F.max("revenue").over(in_order.rangeBetween(-12, -12)))
        .select(
            F.col("year_month").alias("period"),
            "year",
            "month",
            "month_name",
            "quarter",
            "revenue",
            "orders",
            "units",
            F.when(
                F.col("previous") > 0,
                round_half_even(F.try_divide(F.col("revenue") - F.col("previous"), F.col("previous")) * 100, 2),
            ).alias("yoy_growth"),
            round_scaled(F.avg("revenue").over(in_order.rowsBetween(-2, 0)), 2).alias("rolling_3m_revenue"),
            round_scaled(F.sum("revenue").over(in_order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias(
                "running_total_revenue"
            ),
        )
        .orderBy("period")
    )


def profit_trend(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    keys = ["year_month", "year", "month", "month_name"]
    return (
        per_order(
            filters.apply(lines),
            keys,
            {"sales": "sales", "profit": "profit"},
            {"gaining": F.col("profit") > 0, "losing": F.col("profit") <= 0},
        )
        .groupBy(*keys)
        .agg(
            F.sum("sales").alias("sales_sum"),
            _zeroed_money(F.sum("profit")).alias("profit"),
            F.sum("gaining").alias("profitable_orders"),
            F.sum("losing").alias("loss_making_orders"),
        )
        .select(
            F.col("year_month").alias("period"),
            "year",
            "month",
            "month_name",
            "profit",
            guarded_pct("profit", "sales_sum").alias("profit_margin"),
            "profitable_orders",
            "loss_making_orders",
        )
        .orderBy("period")
    )


def _group_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.sum("sales").alias("sales_sum"),
        *_rounded_sums(),
        F.count_distinct("order_id").alias("orders"),
        F.sum("quantity").alias("quantity"),
    )


def category_performance(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    everything = Window.partitionBy()  # one row per category
    return (
        _group_totals(filters.apply(lines), ["category"])
        .withColumn("all_sales", F.sum("sales_sum").over(everything))
        .select(
            "category",
            "revenue",
            "profit",
            _margin(),
            "orders",
            "quantity",
            guarded_pct("revenue", "all_sales").alias("share_of_total"),
        )
        .orderBy(F.col("revenue").desc(), "category")
    )


def subcategory_performance(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    return (
        _group_totals(filters.apply(lines), ["sub_category", "category"])
        .withColumn("parent_sales", F.sum("sales_sum").over(Window.partitionBy("category")))
        .select(
            "sub_category",
            "category",
            "revenue",
            "profit",
            _margin(),
            "orders",
            "quantity",
            guarded_pct("revenue", "parent_sales").alias("share_of_category"),
        )
        .orderBy(F.col("revenue").desc(), "sub_category", "category")
    )


PRODUCT = ["product_id", "product_name", "category", "sub_category"]


def _product_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PRODUCT).agg(
        F.sum("sales").alias("sales_sum"),
        F.sum("profit").alias("profit_sum"),
        *_rounded_sums(),
        F.sum("quantity").alias("quantity"),
        mean("discount").alias("discount_mean"),
    )


def _product_columns() -> list[Column | str]:
    return [
        *PRODUCT,
        "revenue",
        "profit",
        "quantity",
        _margin(),
        F.coalesce(round_half_even(F.col("discount_mean") * 100, 2), F.lit(0.0)).alias("avg_discount"),
    ]


def top_products(
    lines: DataFrame, filters: FilterContext = EVERYTHING, sort_by: str = "revenue", limit: int = 10
) -> DataFrame:
    """The best products by revenue, profit or quantity; anything else means revenue."""
    metric = {"profit": "profit_sum", "quantity": "quantity"}.get(sort_by, "sales_sum")
    return (
        _product_totals(filters.apply(lines))
        .orderBy(F.col(metric).desc(), "product_id")
        .limit(limit)
        .select(*_product_columns())
    )


def loss_making_products(lines: DataFrame, filters: FilterContext = EVERYTHING, limit: int = 10) -> DataFrame:
    """Sums cover losing LINES only, so a product that earns overall can be listed."""
    return (
        _product_totals(filters.apply(lines).filter(F.col("profit") < 0))
        .orderBy("profit_sum", "product_id")
        .limit(limit)
        .select(*_product_columns())
    )


CUSTOMER = ["customer_id", "customer_name", "segment", "country"]


def _customer_totals(lines: DataFrame) -> DataFrame:
    """One row per customer AND country: a customer seen in two countries counts twice."""
    return lines.groupBy(*CUSTOMER).agg(
        F.count_distinct("order_id").alias("order_count"),
        F.sum("sales").alias("spend"),
        F.sum("profit").alias("profit_sum"),
    )


def customer_performance(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    buyers = _customer_totals(filters.apply(lines)).select("spend", (F.col("order_count") > 1).cast("int").alias("again"))
    # Spend ranks come from the histogram of spends; repeat buyers travel in the same rows.
    spends = from_the_top(value_histogram(buyers, ["spend"]))
    fifth = F.greatest(F.floor(F.col("total") * 0.2), F.lit(1))
    repeats = buyers.agg(F.coalesce(F.sum("again"), F.lit(0))).scalar()
    return (
        spends.agg(
            F.coalesce(F.max("total"), F.lit(0)).alias("customers"),
            F.max("amount_total").alias("revenue"),
            amount_of_top(F.col("best"), F.col("worst"), F.col("value"), fifth).alias("top"),
        )
        .withColumn("repeats", repeats)
        .select(
            F.col("customers").alias("total_customers"),
            F.col("repeats").alias("repeat_customers"),
            (F.col("customers") - F.col("repeats")).alias("single_purchase_customers"),
            guarded_pct("repeats", "customers").alias("repeat_customer_rate"),
            guarded_ratio("revenue", "customers").alias("avg_revenue_per_customer"),
            guarded_pct("top", "revenue").alias("customer_contribution_top20"),
        )
    )


def top_customers(lines: DataFrame, filters: FilterContext = EVERYTHING, limit: int = 10) -> DataFrame:
    """The ``limit`` highest spenders, ten unless asked otherwise."""
    return (
        _customer_totals(filters.apply(lines))
        .orderBy(F.col("spend").desc(), "customer_id", "country")
        .limit(limit)
        .withColumn("total_spend", _zeroed_money("spend"))
        .select(
            *CUSTOMER,
            "total_spend",
            _zeroed_money("profit_sum").alias("total_profit"),
            "order_count",
            guarded_ratio("total_spend", "order_count").alias("avg_order_value"),
        )
    )


def customer_segments(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    everything = Window.partitionBy()  # one row per segment
    return (
        filters.apply(lines)
        .groupBy("segment")
        .agg(
            F.count_distinct("customer_id").alias("customer_count"),
            F.sum("sales").alias("sales_sum"),
            *_rounded_sums(),
            F.count_distinct("order_id").alias("orders_count"),
        )
        .withColumn("all_sales", F.sum("sales_sum").over(everything))
        .select(
            "segment",
            "customer_count",
            "revenue",
            "profit",
            _margin(),
            "orders_count",
            guarded_ratio("revenue", "customer_count").alias("avg_spend"),
            guarded_pct("revenue", "all_sales").alias("share_of_revenue"),
        )
        .orderBy(F.col("revenue").desc(), "segment")
    )


def quartile_segment(r: Column, f: Column) -> Column:
    """Segment names by recency and frequency quartile; the first match wins."""
    return labelled(
        [
            ((r >= 3) & (f >= 3), F.lit("Champions")),
            ((r >= 3) & (f >= 2), F.lit("Loyal Customers")),
            (r >= 3, F.lit("Potential Loyalists")),
            ((r == 2) & (f >= 2), F.lit("At Risk")),
            ((r == 1) & (f >= 3), F.lit("Cannot Lose Them")),
        ],
        F.lit("Hibernating"),
    )


def _placed_buyers(lines: DataFrame, filters: FilterContext, by_spend: bool) -> DataFrame:
    buyers = (
        filters.apply(lines)
        .groupBy("customer_id")
        .agg(
            F.max("order_date").alias("last_order"),
            F.count_distinct("order_id").alias("frequency"),
            F.sum("sales").alias("monetary"),
            F.sum("profit").alias("profit"),
        )
    )
    key = F.col("customer_id")
    placed = with_position(buyers, [F.col("last_order").desc(), key], "r_place", total="customers")
    placed = with_position(placed, [F.col("frequency"), key], "f_place")
    if by_spend:
        placed = with_position(placed, [F.col("monetary"), key], "m_place")
    newest = placed.agg(F.max("last_order")).scalar()
    return (
        placed.filter(F.col("customers") >= 4)
        .withColumns(
            {
                "recency": F.datediff(newest, "last_order"),
                "r_score": F.lit(5) - quantile_bin("r_place", "customers", 4),
                "f_score": quantile_bin("f_place", "customers", 4),
            }
        )
        .withColumn("segment", quartile_segment(F.col("r_score"), F.col("f_score")))
    )


def rfm_quartile_scores(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """Quartile scores per customer; no rows when there are fewer than four customers."""
    return (
        _placed_buyers(lines, filters, by_spend=True)
        .withColumn("m_score", quantile_bin("m_place", "customers", 4))
        .select(
            "customer_id",
            "recency",
            "frequency",
            "monetary",
            "profit",
            "r_score",
            "f_score",
            "m_score",
            (F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")).alias("rfm_score"),
            "segment",
        )
    )


def rfm_quartiles(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """Customers, money and averages per segment. The spend score plays no part in the segments."""
    return (
        _placed_buyers(lines, filters, by_spend=False)
        .groupBy("segment", "customers")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            money(F.sum("monetary")).alias("total_revenue"),
            money(F.sum("profit")).alias("total_profit"),
            round_half_even(mean("recency"), 1).alias("avg_recency_days"),
            round_half_even(mean("frequency"), 1).alias("avg_frequency"),
            round_half_even(mean("monetary"), 2).alias("avg_monetary"),
        )
        .withColumn("share_of_customers", guarded_pct("customer_count", "customers"))
        .drop("customers")
        .orderBy(F.col("total_revenue").desc(), "segment")
    )


def geography(lines: DataFrame, filters: FilterContext = EVERYTHING, limit: int = 15) -> DataFrame:
    return (
        _group_totals(filters.apply(lines), ["country", "market", "region"])
        .orderBy(F.col("sales_sum").desc(), "country", "market", "region")
        .limit(limit)
        .select(
            "country",
            F.coalesce("market", F.lit("Global")).alias("market"),
            "region",
            "revenue",
            "profit",
            _margin(),
            "orders",
        )
    )


def shipping(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    return (
        filters.apply(lines)
        .groupBy("ship_mode")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            _zeroed_money(F.sum("sales")).alias("total_revenue"),
            _zeroed_money(F.sum("profit")).alias("total_profit"),
            F.coalesce(round_half_even(mean("shipping_cost"), 2), F.lit(0.0)).alias("avg_shipping_cost"),
            F.coalesce(round_half_even(mean("shipping_days"), 1), F.lit(0.0)).alias("avg_shipping_days"),
        )
        .withColumn("ship_mode", F.coalesce("ship_mode", F.lit("Standard")))
        .orderBy(F.col("total_revenue").desc(), "ship_mode")
    )


def _band_number(discount: Column) -> Column:
    """Which gapped band a discount falls into; null in a gap."""
    number = F.lit(None).cast("int")
    for i, (_, low, high) in enumerate(GAPPED_BANDS):
        inside = (discount >= F.lit(str(low)).cast("decimal(7,4)")) & (discount <= F.lit(str(high)).cast("decimal(7,4)"))
        number = F.when(inside, i).otherwise(number)
    return number


def discount_impact(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """Six bands in one pass. Discounts in the gaps between bands are in none; empty bands stay."""
    spark = lines.sparkSession
    bands = spark.createDataFrame(
        [(i, *band) for i, band in enumerate(GAPPED_BANDS)],
        "band int, discount_band string, min_discount double, max_discount double",
    )
    totals = (
        per_order(
            filters.apply(lines).withColumn("band", _band_number(F.col("discount"))).filter("band IS NOT NULL"),
            ["band"],
            {"sales": "sales", "profit": "profit"},
            {"losing": F.col("profit") < 0},
        )
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("losing").alias("losing"),
            money(F.sum("sales")).alias("revenue"),
            money(F.sum("profit")).alias("profit"),
        )
    )
    return (
        bands.join(totals, "band", "left")
        .na.fill(0.0, ["revenue", "profit"])
        .orderBy("band")
        .select(
            "discount_band",
            "min_discount",
            "max_discount",
            whole("orders").alias("order_count"),
            "revenue",
            "profit",
            _margin(),
            whole("losing").alias("loss_orders_count"),
        )
    )


LEDGER_COLUMNS = [
    "order_id", "order_date", "ship_date", "customer_name", "country", "region", "product_name", "category",
    "sub_category", "quantity", "unit_price", "sales", "discount", "profit", "order_status", "ship_mode",
]


def _ledger(lines: DataFrame, filters: FilterContext, search: str | None) -> DataFrame:
    chosen = filters.apply(lines)
    if search and search.strip():
        chosen = chosen.filter(contains_any(search, "order_id", "customer_name", "product_name", "country"))
    return chosen


EARLY_ROWS = 10_000  # of the ledger, some 200 bytes each: what a task may hold of them


def order_ledger_page(
    lines: DataFrame,
    filters: FilterContext = EVERYTHING,
    page: int = 1,
    page_size: int = 20,
    search: str | None = None,
    sort_by: str = "order_date",
    sort_desc: bool = True,
) -> DataFrame:
    """One page of order lines. Ties in the sort column are broken by the whole row.

    A page that ends within the first ``EARLY_ROWS`` rows is a top-k: every task keeps that many rows at most. For
    any later page the counts of the sort column's values say which values the page holds, at most one per row
    of it. Only rows with these values are numbered over the cluster, and the page is cut out by number, so no
    task ever holds the rows before it and the rest of the selection is not sorted.
    """
    metric = sort_by if sort_by in LEDGER_SORTS else "order_date"
    first = F.col(metric).desc() if sort_desc else F.col(metric).asc()
    columns = [*(["row_id"] if "row_id" in lines.columns else []), *LEDGER_COLUMNS]
    rest = [c for c in columns if c != metric]
    skipped = (page - 1) * page_size
    order = [first, *[F.col(c) for c in rest]]
    found = (
        _ledger(lines, filters, search)
        .withColumn("ship_mode", F.coalesce("ship_mode", F.lit("Standard")))
        .select(*columns)
    )
    if skipped + page_size <= EARLY_ROWS:
        return found.orderBy(*order).offset(skipped).limit(page_size)
    ranges = ranges_of_values(found, metric, first)
    held = ranges.filter((F.col("start") < skipped + page_size) & (F.col("stop") > skipped))
    rows = found.join(F.broadcast(held.select(F.col(metric).alias("_held"))), F.col(metric).eqNullSafe(F.col("_held")))
    before = held.agg(F.coalesce(F.min("start"), F.lit(0))).scalar()
    numbered = with_position(rows.drop("_held"), order, "place").withColumn("place", F.col("place") + before)
    return numbered.filter(F.col("place").between(skipped + 1, skipped + page_size)).orderBy("place").drop("place")


def order_ledger_info(
    lines: DataFrame,
    filters: FilterContext = EVERYTHING,
    page: int = 1,
    page_size: int = 20,
    search: str | None = None,
) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_records") / page_size)).cast("int")
    return (
        _ledger(lines, filters, search)
        .agg(F.count(F.lit(1)).alias("total_records"))
        .select(
            "total_records",
            F.lit(page).alias("page"),
            F.lit(page_size).alias("page_size"),
            pages.alias("total_pages"),
        )
    )


def returns_summary(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    return kpi_summary(lines, filters).select(
        F.col("total_returned_orders").alias("total_returns"), "return_rate", "returned_revenue"
    )


def _top_returned(lines: DataFrame, filters: FilterContext, keys: list[str], limit: int) -> DataFrame:
    return (
        filters.apply(lines)
        .filter("is_returned")
        .groupBy(*keys)
        .agg(F.count_distinct("order_id").alias("return_count"), money(F.sum("sales")).alias("returned_revenue"))
        .orderBy(F.col("return_count").desc(), *keys)
        .limit(limit)
    )


def top_returned_products(lines: DataFrame, filters: FilterContext = EVERYTHING, limit: int = 5) -> DataFrame:
    return _top_returned(lines, filters, ["product_name", "category"], limit)


def top_returned_customers(lines: DataFrame, filters: FilterContext = EVERYTHING, limit: int = 5) -> DataFrame:
    return _top_returned(lines, filters, ["customer_name", "country"], limit)


def _number(value: str, digits: int) -> Column:
    return F.format_number(F.col(value), digits)


def _plain(value: str, digits: int) -> Column:
    return F.regexp_replace(F.format_number(F.col(value), digits), ",", "")


def _sentence(place: int, title: Column, description: Column, topic: str, status: Column) -> list[Column]:
    return [
        F.lit(place).alias("place"),
        title.alias("title"),
        description.alias("description"),
        F.lit(topic).alias("category"),
        status.alias("status"),
    ]


def insights(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """Up to five sentences about the selection. Each comes from a report of one row."""
    period = f"in {filters.year}" if filters.year else "across all historical periods"
    margin = F.col("profit_margin")
    overall = kpi_summary(lines, filters).select(
        *_sentence(
            1,
            F.lit(f"Revenue & Profit Summary ({period})"),
            F.concat(
                F.lit("Generated $"), _number("total_revenue", 2),
                F.lit(" in gross sales with a net profit of $"), _number("total_profit", 2),
                F.lit(", delivering an overall commercial profit margin of "), _plain("profit_margin", 2), F.lit("%."),
            ),
            "sales",
            F.when(margin > 10, "positive").when(margin > 0, "neutral").otherwise("negative"),
        )
    )
    leader = category_performance(lines, filters).limit(1).select(
        *_sentence(
            2,
            F.concat(F.lit("Category Leader: "), "category"),
            F.concat(
                F.col("category"), F.lit(" is the primary revenue driver, contributing $"), _number("revenue", 2),
                F.lit(" ("), _plain("share_of_total", 1), F.lit("% of total revenue) with a "),
                _plain("profit_margin", 1), F.lit("% profit margin."),
            ),
            "category",
            F.lit("positive"),
        )
    )
    worst = loss_making_products(lines, filters, limit=1).withColumn("loss", F.abs("profit")).select(
        *_sentence(
            3,
            F.concat(F.lit("Margin Drainage Alert: "), "product_name"),
            F.concat(
                F.lit("This product created the largest commercial loss at -$"), _number("loss", 2),
                F.lit(" on $"), _number("revenue", 2),
                F.lit(" sales with an average discount rate of "), _plain("avg_discount", 1), F.lit("%."),
            ),
            "risk",
            F.lit("negative"),
        )
    )
    territory = geography(lines, filters, limit=1).select(
        *_sentence(
            4,
            F.concat(F.lit("Top Geographical Market: "), "country"),
            F.concat(
                F.col("country"), F.lit(" ("), F.col("region"), F.lit(" region) produced $"), _number("revenue", 2),
                F.lit(" across "), _number("orders", 0),
                F.lit(" orders with a net margin of "), _plain("profit_margin", 1), F.lit("%."),
            ),
            "geography",
            F.lit("info"),
        )
    )
    # The sentence speaks of all deep discounts but describes the first deep band only.
    deep = discount_impact(lines, filters).filter("min_discount >= 0.3").orderBy("min_discount").limit(1)
    discounting = deep.filter("order_count > 0").select(
        *_sentence(
            5,
            F.concat(F.lit("Discounting Elasticity Warning ("), "discount_band", F.lit(")")),
            F.concat(
                F.lit("Orders discounted at >30% resulted in a profit margin of "), _plain("profit_margin", 1),
                F.lit("% with "), _number("loss_orders_count", 0), F.lit(" unprofitable transactions."),
            ),
            "discount",
            F.when(margin < 0, "negative").otherwise("neutral"),
        )
    )
    found = overall
    for sentence in (leader, worst, territory, discounting):
        found = found.unionByName(sentence)
    return found.orderBy("place")


OPTION_COLUMNS = ["year", "country", "market", "region", "category", "sub_category", "segment", "ship_mode"]


def filter_options(lines: DataFrame) -> DataFrame:
    """Every value a filter can take, as (field, value) rows, from one pass over the lines."""
    seen = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in OPTION_COLUMNS])
    values = (
        lines.groupBy(*OPTION_COLUMNS)
        .agg(F.lit(1).alias("present"))
        .select(F.explode(seen).alias("option"))
        .select("option.field", "option.value")
        .filter(F.coalesce(F.length("value"), F.lit(0)) > 0)
        .distinct()
    )
    bounds = lines.agg(F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"))
    days = bounds.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
                    for c in ("min_date", "max_date")
                ]
            )
        ).alias("option")
    ).select("option.field", "option.value")
    # Lists that do not depend on the data.
    fixed = [("quarter", f"Q{n}") for n in range(1, 5)]
    fixed += [("order_status", status) for status in ("Completed", "Returned")]
    constant = lines.sparkSession.createDataFrame(fixed, "field string, value string")
    months = lines.sparkSession.range(1, 13).select(
        F.lit("month").alias("field"), F.date_format(F.make_date(F.lit(2000), F.col("id").cast("int"), F.lit(1)), "MMMM").alias("value")
    )
    return values.unionByName(days).unionByName(constant).unionByName(months).orderBy("field", "value")


# Headers of the exported file, by column.
EXPORT_HEADERS = {
    "order_id": "Order ID",
    "order_date": "Order Date",
    "ship_date": "Ship Date",
    "ship_mode": "Ship Mode",
    "customer_id": "Customer ID",
    "customer_name": "Customer Name",
    "segment": "Segment",
    "country": "Country",
    "city": "City",
    "state": "State",
    "postal_code": "Postal Code",
    "region": "Region",
    "product_id": "Product ID",
    "category": "Category",
    "sub_category": "Sub-Category",
    "product_name": "Product Name",
    "sales": "Sales",
    "quantity": "Quantity",
    "discount": "Discount",
    "profit": "Profit",
    "shipping_days": "Shipping Days",
    "profit_margin": "Profit Margin",
}


def dataset_export(lines: DataFrame, filters: FilterContext = EVERYTHING) -> DataFrame:
    """The filtered lines under their published headers, ready for a CSV sink."""
    return filters.apply(lines).select(*[F.col(name).alias(header) for name, header in EXPORT_HEADERS.items()])
