"""Recency, frequency and monetary segmentation on a five-level scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.expr import labelled, mean, money, pct, quantile_bin, ratio, round_half_up, round_scaled
from tallyworks.operators.ranking import percentiles_of, value_histogram, with_position

FIFTHS = {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8}


def _edges(histogram: DataFrame, column: str) -> Column:
    """The four inner edges of a value's quintiles, as a one-row lookup.

    A customer's level is one more than the number of edges below its value, so equal edges simply
    leave a level empty.
    """
    edges = percentiles_of(histogram.filter(F.col("column") == column), FIFTHS)
    return edges.select(F.array(*FIFTHS)).scalar()


def _level(value: Column, edges: Column) -> Column:
    above = F.lit(1)
    for place in range(4):
        above = above + (value > F.element_at(edges, place + 1)).cast("int")
    return above


def nine_segments(r: Column, f: Column, m: Column) -> Column:
    return labelled(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), F.lit("Champions")),
            ((r >= 3) & (f >= 3) & (m >= 3), F.lit("Loyal Customers")),
            ((r >= 4) & (f <= 2) & (m >= 2), F.lit("Potential Loyalists")),
            ((r >= 4) & (f == 1) & (m == 1), F.lit("New Customers")),
            ((r <= 2) & (f >= 3) & (m >= 3), F.lit("At Risk")),
            ((r >= 3) & (f <= 2) & (m <= 2), F.lit("Need Attention")),
            ((r <= 2) & (f <= 2) & (m >= 3), F.lit("About to Sleep")),
            ((r <= 2) & (f <= 2) & (m <= 2), F.lit("Lost Customers")),
        ],
        F.lit("Hibernating"),
    )


def seven_segments(r: Column, f: Column, m: Column) -> Column:
    return labelled(
        [
            ((r >= 4) & (f >= 4) & (m >= 4), F.lit("Champions")),
            ((r >= 3) & (f >= 3) & (m >= 3), F.lit("Loyal Customers")),
            ((r >= 4) & (f <= 3), F.lit("Potential Loyalists")),
            ((r <= 2) & (f >= 3) & (m >= 3), F.lit("At Risk")),
            ((r <= 2) & (f <= 2) & (m >= 3), F.lit("About to Sleep")),
            ((r <= 2) & (f <= 2) & (m <= 2), F.lit("Hibernating / Lost")),
        ],
        F.lit("Promising / Needs Attention"),
    )


def customer_base(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per customer."""
    return lines.groupBy(*keys).agg(
        F.count_distinct("order_id").alias("frequency"),
        F.sum("sales").alias("monetary"),
        F.sum("profit").alias("total_profit"),
        F.sum("quantity").alias("total_quantity"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )


def _scored(base: DataFrame, days_after: int) -> DataFrame:
    # The positions come from a checkpoint, which everything below reads instead of the lines.
    keys = [F.col(c) for c in ("customer_id", "customer_name", "segment") if c in base.columns]
    placed = with_position(base, [F.col("frequency"), *keys], "f_place", total="customers")
    newest = placed.agg(F.date_add(F.max("last_order_date"), days_after)).scalar()
    placed = placed.withColumn("recency", F.datediff(newest, "last_order_date"))
    histogram = value_histogram(placed, ["recency", "monetary"])
    return placed.withColumns(
        {
            "r_score": F.lit(6) - _level(F.col("recency"), _edges(histogram, "recency")),
            "f_score": quantile_bin("f_place", "customers", 5),
            "m_score": _level(F.col("monetary").cast("double"), _edges(histogram, "monetary")),
        }
    ).drop("f_place", "customers")


def rfm_quintiles(lines: DataFrame) -> DataFrame:
    """The customer segmentation table: metrics, scores and one of nine segments."""
    scored = _scored(customer_base(lines, ["customer_id", "customer_name", "segment"]), days_after=0)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "customer_id",
        "customer_name",
        "segment",
        "recency",
        "frequency",
        "monetary",
        "total_profit",
        "total_quantity",
        "first_order_date",
        "last_order_date",
        round_scaled(ratio("monetary", "frequency"), 2).alias("aov"),
        round_scaled(ratio("total_profit", "monetary") * 100, 2).alias("profit_margin_pct"),
        "r_score",
        "f_score",
        "m_score",
        F.concat(r, f, m).alias("rfm_score"),
        (r + f + m).alias("rfm_combined_score"),
        nine_segments(r, f, m).alias("rfm_segment"),
    )


def rfm_seven_segments(lines: DataFrame) -> DataFrame:
    """The variant with seven segments and recency counted from the day after the last order."""
    names = F.min_by(F.struct("customer_name", "segment"), F.struct("first_order_date", "customer_name", "segment"))
    base = customer_base(lines, ["customer_id", "customer_name", "segment"])
    merged = base.groupBy("customer_id").agg(
        names.alias("names"),
        F.sum("frequency").alias("frequency"),
        F.sum("monetary").alias("monetary"),
        F.sum("total_profit").alias("total_profit"),
        F.max("last_order_date").alias("last_order_date"),
    )
    scored = _scored(merged, days_after=1)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "customer_id",
        F.col("recency").alias("recency_days"),
        F.col("frequency").alias("frequency_orders"),
        money("monetary").alias("monetary_value"),
        F.round("total_profit", 4).cast("double").alias("total_profit"),
        "names.customer_name",
        "names.segment",
        "r_score",
        "f_score",
        "m_score",
        seven_segments(r, f, m).alias("customer_segment"),
    )


def segment_summary(rfm: DataFrame) -> DataFrame:
    totals = rfm.agg(
        F.struct(
            F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("sales"), F.sum("total_profit").alias("profit")
        )
    ).scalar()
    return (
        rfm.groupBy("rfm_segment")
        .agg(
            F.count("customer_id").alias("customer_count"),
            F.sum("monetary").alias("sales_sum"),
            F.sum("total_profit").alias("profit_sum"),
            round_half_up(mean("monetary"), 2).alias("avg_sales"),
            round_half_up(mean("total_profit"), 2).alias("avg_profit"),
            round_half_up(mean("frequency"), 4).alias("avg_frequency"),
            round_half_up(mean("recency"), 4).alias("avg_recency"),
        )
        .withColumn("all", totals)
        .select(
            "rfm_segment",
            "customer_count",
            money("sales_sum").alias("total_sales"),
            money("profit_sum").alias("total_profit"),
            "avg_sales",
            "avg_profit",
            "avg_frequency",
            "avg_recency",
            pct("customer_count", "all.customers").alias("pct_customers"),
            pct("sales_sum", "all.sales").alias("pct_sales"),
            pct("profit_sum", "all.profit").alias("pct_profit"),
            pct("profit_sum", "sales_sum").alias("profit_margin_pct"),
        )
        .orderBy(F.col("total_sales").desc(), "rfm_segment")
    )


def customer_highlights(rfm: DataFrame, k: int = 10, spend_floor: int = 5000) -> DataFrame:
    """Top customers by spend, profit and frequency, big spenders at a loss, and the at-risk group."""

    def group(name: str, chosen: DataFrame) -> DataFrame:
        return chosen.select(
            F.lit(name).alias("highlight"),
            "customer_id",
            "customer_name",
            money("monetary").alias("total_sales"),
            money("total_profit").alias("total_profit"),
            "frequency",
            "rfm_segment",
        )

    def best(metric: str) -> DataFrame:
        return rfm.orderBy(F.col(metric).desc(), "customer_id").limit(k)

    found = group("top_by_sales", best("monetary"))
    for name, chosen in (
        ("top_by_profit", best("total_profit")),
        ("top_by_frequency", best("frequency")),
        ("high_sales_at_loss", rfm.filter((F.col("monetary") > spend_floor) & (F.col("total_profit") < 0))),
        ("at_risk", rfm.filter(F.col("rfm_segment") == "At Risk")),
    ):
        found = found.unionByName(group(name, chosen))
    return found


def reconcile(rfm: DataFrame, lines: DataFrame) -> DataFrame:
    """One row of checks: customers, sums, duplicates and gaps of the segmentation against the lines."""
    source = lines.agg(
        F.struct(
            F.count_distinct("customer_id").alias("customers"),
            F.sum("sales").alias("sales"),
            F.sum("profit").alias("profit"),
        )
    ).scalar()
    return (
        rfm.agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_distinct("customer_id").alias("ids"),
            F.sum("monetary").alias("sales"),
            F.sum("total_profit").alias("profit"),
            F.count_if(F.col("r_score").isNull()).alias("no_score"),
            F.count_if(F.col("rfm_segment").isNull()).alias("no_segment"),
        )
        .withColumn("source", source)
        .select(
            (F.col("customers") == F.col("source.customers")).alias("customer_count_ok"),
            (F.abs(F.col("sales") - F.col("source.sales")) < 0.01).alias("sales_ok"),
            (F.abs(F.col("profit") - F.col("source.profit")) < 0.01).alias("profit_ok"),
            (F.col("customers") - F.col("ids")).alias("duplicate_customers"),
            F.col("no_score").alias("missing_scores"),
            F.col("no_segment").alias("missing_segments"),
        )
    )
