"""Exploratory statistics of the cleaned order lines, including the series behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.expr import growth_pct, mean, money, pct, ratio, round_half_up
from tallyworks.operators.ranking import amount_of_top, from_the_top, select_quantiles, value_histogram
from tallyworks.sources.schema import MONEY

RATE = 4  # digits kept in printed rates


def _sums() -> list[Column]:
    return [F.sum("sales").alias("sales_sum"), F.sum("profit").alias("profit_sum")]


def _money_columns() -> list[Column]:
    return [money("sales_sum").alias("sales"), money("profit_sum").alias("profit")]


def _margin() -> Column:
    return pct("profit_sum", "sales_sum", RATE).alias("profit_margin")


def _grouped(lines: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    return lines.groupBy(*keys).agg(
        *_sums(), F.sum("quantity").alias("quantity"), F.count_distinct("order_id").alias("orders"), *extra
    )


def overview(lines: DataFrame) -> DataFrame:
    totals = lines.agg(
        *_sums(),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("order_id").alias("total_orders"),
        mean("discount").alias("discount_mean"),
        mean("shipping_days").alias("days_mean"),
    )
    return totals.select(
        money("sales_sum").alias("total_sales"),
        money("profit_sum").alias("total_profit"),
        "total_quantity",
        "total_orders",
        round_half_up(ratio("sales_sum", "total_orders"), 2).alias("average_order_value"),
        pct("profit_sum", "sales_sum").alias("profit_margin"),
        round_half_up(F.col("discount_mean") * 100, 2).alias("average_discount"),
        round_half_up("days_mean", 2).alias("average_shipping_days"),
    )


def yearly(lines: DataFrame) -> DataFrame:
    before = Window.orderBy("year")  # a handful of years
    return (
        _grouped(lines, ["year"])
        .select(
            "year",
            *_money_columns(),
            "quantity",
            "orders",
            _margin(),
            growth_pct(
                F.col("sales_sum").cast("double"), F.lag(F.col("sales_sum").cast("double")).over(before), RATE
            ).alias("yoy_sales_growth"),
            growth_pct(
                F.col("profit_sum").cast("double"), F.lag(F.col("profit_sum").cast("double")).over(before), RATE
            ).alias("yoy_profit_growth"),
        )
        .orderBy("year")
    )


def monthly(lines: DataFrame) -> DataFrame:
    return (
        _grouped(lines, ["year_month"]).select("year_month", *_money_columns(), "orders", _margin()).orderBy("year_month")
    )


def top_months(lines: DataFrame, k: int = 5) -> DataFrame:
    return monthly(lines).orderBy(F.col("sales").desc(), "year_month").limit(k)


def seasonality(lines: DataFrame) -> DataFrame:
    return (
        _grouped(lines, ["month"])
        .select(
            F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM").alias("month_name"),
            F.col("month").alias("month_number"),
            *_money_columns(),
            "orders",
        )
        .orderBy("month_number")
    )


def quarterly(lines: DataFrame) -> DataFrame:
    return _grouped(lines, ["year", "quarter"]).select("year", "quarter", *_money_columns()).orderBy("year", "quarter")


def _with_shares(lines: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    everything = Window.partitionBy()  # one row per category or segment
    return (
        _grouped(lines, keys, *extra)
        .withColumn("sales_share", pct("sales_sum", F.sum("sales_sum").over(everything), RATE))
        .withColumn("profit_share", pct("profit_sum", F.sum("profit_sum").over(everything), RATE))
    )


def categories(lines: DataFrame) -> DataFrame:
    return (
        _with_shares(lines, ["category"])
        .select("category", *_money_columns(), "quantity", "orders", _margin(), "sales_share", "profit_share")
        .orderBy(F.col("sales").desc(), "category")
    )


def subcategories(lines: DataFrame) -> DataFrame:
    return (
        _grouped(lines, ["category", "sub_category"])
        .select("category", "sub_category", *_money_columns(), "quantity", "orders", _margin())
        .orderBy(F.col("profit").desc(), "category", "sub_category")
    )


def loss_subcategories(lines: DataFrame) -> DataFrame:
    return (
        _grouped(lines, ["category", "sub_category"])
        .filter(F.col("profit_sum") < 0)
        .select("sub_category", "category", *_money_columns(), _margin())
        .orderBy("category", "sub_category")
    )


PRODUCT = ["product_id", "product_name", "category", "sub_category"]


def _products(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PRODUCT).agg(*_sums(), F.sum("quantity").alias("quantity"))


def product_extremes(lines: DataFrame, k: int = 10) -> DataFrame:
    """Best products by sales and by profit, and the worst by profit."""
    totals = _products(lines)

    def listed(name: str, order: Column) -> DataFrame:
        return (
            totals.orderBy(order, "product_id")
            .limit(k)
            .select(F.lit(name).alias("list"), *PRODUCT, *_money_columns(), "quantity", _margin())
        )

    return (
        listed("top_by_sales", F.col("sales_sum").desc())
        .unionByName(listed("top_by_profit", F.col("profit_sum").desc()))
        .unionByName(listed("bottom_by_profit", F.col("profit_sum").asc()))
    )


def high_sales_loss_products(lines: DataFrame, floor: int = 3000) -> DataFrame:
    return (
        _products(lines)
        .filter((F.col("sales_sum") > floor) & (F.col("profit_sum") < 0))
        .select("product_id", "product_name", *_money_columns(), _margin())
        .orderBy("product_id")
    )


def customers(lines: DataFrame, k: int = 10) -> DataFrame:
    """Means per customer and the part of revenue held by the top ``k`` and the top fifth."""
    spend = lines.groupBy("customer_id", "customer_name", "segment").agg(
        F.sum("sales").alias("spend"), F.sum("profit").alias("profit_sum")
    )
    all_profit = lines.agg(F.sum("profit")).scalar()
    spends = from_the_top(value_histogram(spend, ["spend"]))
    best, worst, value = F.col("best"), F.col("worst"), F.col("value")
    fifth = F.floor(F.col("total") * 0.2)
    return (
        spends.agg(
            F.max("total").alias("customers"),
            F.max("amount_total").alias("sales_sum"),
            F.max(fifth).alias("fifth_count"),
            amount_of_top(best, worst, value, F.lit(k)).alias("top_k"),
            amount_of_top(best, worst, value, fifth).alias("top_fifth"),
        )
        .withColumn("profit_sum", all_profit)
        .select(
            F.col("customers").alias("total_customers"),
            round_half_up(ratio("sales_sum", "customers"), 2).alias("avg_sales_per_customer"),
            round_half_up(ratio("profit_sum", "customers"), 2).alias("avg_profit_per_customer"),
            pct("top_k", "sales_sum").alias(f"top{k}_contribution_pct"),
            money("top_k").alias(f"top{k}_sales"),
            F.col("fifth_count").alias("top20pct_customers"),
            pct("top_fifth", "sales_sum").alias("top20pct_contribution_pct"),
            money("top_fifth").alias("top20pct_sales"),
        )
    )


def segments(lines: DataFrame) -> DataFrame:
    return (
        _with_shares(lines, ["segment"], F.count_distinct("customer_id").alias("customers"))
        .select(
            "segment", *_money_columns(), "quantity", "orders", "customers", _margin(), "sales_share", "profit_share"
        )
        .orderBy("segment")
    )


def regions(lines: DataFrame) -> DataFrame:
    return (
        _grouped(lines, ["region"])
        .select("region", *_money_columns(), "orders", _margin())
        .orderBy(F.col("profit").desc(), "region")
    )


def _states(lines: DataFrame) -> DataFrame:
    return _grouped(lines, ["state", "region"], mean("discount").alias("discount_mean"))


def state_lists(lines: DataFrame, k: int = 5) -> DataFrame:
    """The best and worst states, and every state with a loss."""
    totals = _states(lines)

    def listed(name: str, chosen: DataFrame) -> DataFrame:
        return chosen.select(
            F.lit(name).alias("list"),
            "state",
            "region",
            *_money_columns(),
            _margin(),
            round_half_up(F.col("discount_mean") * 100, RATE).alias("avg_discount_pct"),
        )

    return (
        listed("top_by_profit", totals.orderBy(F.col("profit_sum").desc(), "state", "region").limit(k))
        .unionByName(listed("bottom_by_profit", totals.orderBy("profit_sum", "state", "region").limit(k)))
        .unionByName(listed("loss_making", totals.filter(F.col("profit_sum") < 0)))
    )


def discount_exact(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("discount")
        .agg(F.count(F.lit(1)).alias("transaction_count"), *_sums())
        .select(
            F.col("discount").cast("double").alias("discount"),
            "transaction_count",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            round_half_up(ratio("profit_sum", "transaction_count"), RATE).alias("avg_profit_per_order"),
            _margin(),
        )
        .orderBy("discount")
    )


def discount_rounded(lines: DataFrame) -> DataFrame:
    """By whole discount percent (half to even), with the mean of the line margins."""
    whole_pct = F.bround(F.col("discount") * 100, 0).cast("int")
    return (
        lines.groupBy(whole_pct.alias("discount_pct"))
        .agg(
            F.count(F.lit(1)).alias("sales_count"),
            *_sums(),
            round_half_up(mean("sales"), RATE).alias("sales_mean"),
            round_half_up(mean("profit"), RATE).alias("profit_mean"),
            # Line margins carry four digits, so as decimals their sum does not depend on row order.
            round_half_up(mean(F.col("profit_margin").cast("decimal(12,4)")), RATE).alias("margin_mean"),
        )
        .select(
            "discount_pct",
            "sales_count",
            money("sales_sum").alias("sales"),
            "sales_mean",
            money("profit_sum").alias("profit"),
            "profit_mean",
            "margin_mean",
        )
        .orderBy("discount_pct")
    )


CORRELATED = ["sales", "quantity", "discount", "profit", "shipping_days"]


def correlation_matrix(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair, in long form, from one aggregate of the upper triangle."""
    names = columns or CORRELATED
    values = {name: F.col(name).cast("double") for name in names}
    upper = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = lines.agg(*[F.corr(values[a], values[b]).alias(f"{a}~{b}") for a, b in upper])

    def cell(a: str, b: str) -> Column:
        name = f"{a}~{b}" if (a, b) in upper else f"{b}~{a}"
        value = F.lit(1.0) if a == b else round_half_up(F.col(f"`{name}`"), 6)
        return F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("correlation"))

    return row.select(F.explode(F.array(*[cell(a, b) for a in names for b in names])).alias("cell")).select("cell.*")


def shipping(lines: DataFrame) -> DataFrame:
    return (
        _grouped(
            lines,
            ["ship_mode"],
            mean("shipping_days").alias("days_mean"),
            F.min("shipping_days").alias("min_shipping_days"),
            F.max("shipping_days").alias("max_shipping_days"),
        )
        .select(
            "ship_mode",
            round_half_up("days_mean", RATE).alias("avg_shipping_days"),
            "min_shipping_days",
            "max_shipping_days",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            F.col("orders").alias("order_count"),
            _margin(),
        )
        .orderBy("avg_shipping_days", "ship_mode")
    )


OUTLIER_COLUMNS = ["sales", "quantity", "discount", "profit"]


def iqr_outliers(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values outside 1.5 interquartile ranges. Quartiles are exact and interpolated.

    They are selected by a few passes of counts over the columns; the outliers take one more.
    """
    found = select_quantiles(lines, columns or OUTLIER_COLUMNS, {"q1": 0.25, "q3": 0.75}, MONEY)
    rows = []
    for number, row in enumerate(found):
        reach = 1.5 * (row["q3"] - row["q1"])
        rows.append((number, row["column"], row["q1"] - reach, row["q3"] + reach, row["min"], row["max"]))
    bounds = lines.sparkSession.createDataFrame(rows, "number int, column string, lower double, upper double, min double, max double")

    def outside(row: tuple) -> Column:
        value = F.col(row[1]).cast(MONEY).cast("double")
        return F.coalesce(F.count_if((value < row[2]) | (value > row[3])), F.lit(0))

    counts = lines.agg(F.array(*[outside(row) for row in rows]).cast("array<bigint>").alias("n"))
    counts = counts.select(F.posexplode("n").alias("number", "outliers"))
    # One row per column name.
    return bounds.join(F.broadcast(counts), "number").select(
        F.col("column").alias("column_name"),
        "outliers",
        round_half_up("lower", 2).alias("lower_bound"),
        round_half_up("upper", 2).alias("upper_bound"),
        round_half_up("min", 2).alias("min_value"),
        round_half_up("max", 2).alias("max_value"),
    )


def state_extremes(lines: DataFrame, k: int = 5) -> DataFrame:
    totals = lines.groupBy("state").agg(F.sum("profit").alias("profit_sum"))
    bottom = totals.orderBy("profit_sum", "state").limit(k)
    top = totals.orderBy(F.col("profit_sum").desc(), "state").limit(k)
    return bottom.unionByName(top).select("state", money("profit_sum").alias("profit")).orderBy("profit", "state")


def discount_margin_series(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("discount")
        .agg(*_sums(), F.count_distinct("order_id").alias("orders"))
        .select(F.col("discount").cast("double").alias("discount"), *_money_columns(), "orders", _margin())
        .orderBy("discount")
    )


def region_series(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy("region").agg(*_sums()).select("region", *_money_columns()).orderBy(F.col("sales").desc(), "region")
    )


def top_names(lines: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The ``k`` biggest names by sales, smallest first, as a horizontal bar chart lists them."""
    return (
        lines.groupBy(name)
        .agg(F.sum("sales").alias("sales_sum"))
        .orderBy(F.col("sales_sum").desc(), name)
        .limit(k)
        .select(name, money("sales_sum").alias("sales"))
        .orderBy("sales", name)
    )
