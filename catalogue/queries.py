"""Every query by name. Each takes a session and the folder of the trade tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from catalogue.raw_lines import raw_order_lines, returns_ledger
from tallyworks.functions.measures import LINE_MEASURES
from tallyworks.operators import cleaning
from tallyworks.operators.filters import FilterContext
from tallyworks.plans import eda, flat_suite, forecast, measures, rfm, service, star, star_suite
from tallyworks.session import shared_folder
from tallyworks.sources import sinks
from tallyworks.sources.flat import customer_rfm, order_lines, read_flat, read_rejected, star_tables
from tallyworks.streaming import events, ingest

Query = Callable[[SparkSession, str], DataFrame]


def plain(result: DataFrame) -> DataFrame:
    """Dates as ISO text and decimals as doubles, so that any client reads the same values."""
    columns = []
    for field in result.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            column = column.cast("string").alias(field.name)
        elif isinstance(field.dataType, DecimalType):
            column = column.cast("double").alias(field.name)
        columns.append(column)
    return result.select(*columns)


def on_lines(report: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: plain(report(order_lines(spark, folder), **options))


def on_star(report: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: plain(report(star_tables(spark, folder), **options))


def on_rfm(report: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, folder: plain(report(customer_rfm(spark, folder), **options))


FLAT = {
    "q01_core_kpis": flat_suite.core_kpis,
    "q02_sales_profit_by_year": flat_suite.sales_profit_by_year,
    "q03_yoy_growth_analysis": flat_suite.yoy_growth,
    "q04_monthly_sales_trend": flat_suite.monthly_sales_trend,
    "q05_quarterly_performance": flat_suite.quarterly_performance,
    "q06_seasonality_by_month": flat_suite.seasonality_by_month,
    "q07_category_performance": flat_suite.category_performance,
    "q08_subcategory_performance": flat_suite.subcategory_performance,
    "q09_top10_products_sales": flat_suite.top_products_by_sales,
    "q10_top10_products_profit": flat_suite.top_products_by_profit,
    "q11_bottom10_products_loss": flat_suite.bottom_products,
    "q12_high_sales_negative_profit": flat_suite.high_sales_negative_profit,
    "q13_top10_customers_sales": flat_suite.top_customers_by_sales,
    "q14_top10_customers_profit": flat_suite.top_customers_by_profit,
    "q15_customer_pareto_distribution": flat_suite.customer_pareto,
    "q16_regional_performance": flat_suite.regional_performance,
    "q17_state_profitability_ranking": flat_suite.state_profitability_ranking,
    "q18_customer_segment_performance": flat_suite.segment_performance,
    "q19_ship_mode_performance": flat_suite.ship_mode_performance,
    "q20_discount_bands_profitability": flat_suite.discount_bands,
    "q21_running_totals_over_time": flat_suite.running_totals,
    "q22_subcategory_share_of_category": flat_suite.subcategory_share,
    "q23_customer_repeat_buyer_cohorts": flat_suite.buyer_cohorts,
    "q24_rolling_3m_average": flat_suite.rolling_3m_average,
    "q25_top_loss_making_states_breakdown": flat_suite.loss_making_states,
}

STAR = {
    "star_kpis": star_suite.star_kpis,
    "star_yoy": star_suite.star_yoy,
    "star_rolling_3m": star_suite.star_rolling_3m,
    "star_running_totals": star_suite.star_running_totals,
    "star_category_matrix": star_suite.star_category_matrix,
    "star_subcat_share": star_suite.star_subcategory_share,
    "star_top_products": star_suite.star_top_products,
    "star_loss_products": star_suite.star_loss_products,
    "discount_bracket_tiers": star_suite.discount_bracket_tiers,
    "deep_discount_audit": star_suite.deep_discount_audit,
    "star_region_rank": star_suite.star_region_rank,
    "star_loss_states": star_suite.star_loss_states,
    "top_cities": star_suite.top_cities,
    "customer_ltv": star_suite.customer_ltv,
    "rfm_ntile": star_suite.rfm_ntile,
    "star_pareto": star_suite.star_pareto,
    "star_segment_perf": star_suite.star_segment_performance,
    "star_buyer_cohorts": star_suite.star_buyer_cohorts,
    "star_ship_modes": star_suite.star_ship_modes,
    "delivery_delay": star_suite.delivery_delay,
    "basket_pairs": star_suite.basket_pairs,
    "acquisition_cohorts": star_suite.acquisition_cohorts,
    "dim_customer": lambda tables: tables.customer,
    "dim_product": lambda tables: tables.product,
    "dim_geography": lambda tables: tables.geography,
    "dim_shipping": star.shipping_usage,
    "dim_date": lambda tables: tables.date,
    "fact_sales": lambda tables: tables.fact.drop("order_year"),
    "ship_date_role": star.sales_by_ship_month,
    "measure_reconcile": measures.measure_reconcile,
}

SERVICE = {
    "kpi_summary": service.kpi_summary,
    "sales_trend": service.sales_trend,
    "profit_trend": service.profit_trend,
    "category_performance": service.category_performance,
    "subcategory_performance": service.subcategory_performance,
    "top_products": service.top_products,
    "loss_making_products": service.loss_making_products,
    "customer_performance": service.customer_performance,
    "top_customers": service.top_customers,
    "customer_segments": service.customer_segments,
    "rfm_quartiles": service.rfm_quartiles,
    "geography": service.geography,
    "shipping": service.shipping,
    "discount_impact": service.discount_impact,
    "order_ledger_page": service.order_ledger_page,
    "returns_summary": service.returns_summary,
    "top_returned_products": service.top_returned_products,
    "top_returned_customers": service.top_returned_customers,
    "insights": service.insights,
    "filter_options": service.filter_options,
    "dataset_export": service.dataset_export,
}

EDA = {
    "eda_overview": eda.overview,
    "eda_yearly": eda.yearly,
    "eda_monthly": eda.monthly,
    "eda_top_months": eda.top_months,
    "eda_seasonality": eda.seasonality,
    "eda_quarterly": eda.quarterly,
    "eda_category": eda.categories,
    "eda_subcategory": eda.subcategories,
    "eda_loss_subcats": eda.loss_subcategories,
    "eda_products": eda.product_extremes,
    "eda_high_sales_loss": eda.high_sales_loss_products,
    "eda_customers": eda.customers,
    "eda_segments": eda.segments,
    "eda_regions": eda.regions,
    "eda_states": eda.state_lists,
    "discount_exact": eda.discount_exact,
    "discount_rounded": eda.discount_rounded,
    "correlation_matrix": eda.correlation_matrix,
    "eda_shipping": eda.shipping,
    "iqr_outliers": eda.iqr_outliers,
    "state_extremes": eda.state_extremes,
    "chart_discount_margin": eda.discount_margin_series,
    "chart_regions": eda.region_series,
}

# A selection that uses most fields of the filter context.
SELECTION = FilterContext(
    market="ASIA", order_status="Completed", quarter="Q2", country="all", start_date="1996-02-10", end_date="2000-11-20"
)


def _time_measure(name: str) -> Query:
    return lambda spark, folder: plain(
        measures.monthly_time_intelligence(order_lines(spark, folder)).select("year_month", name)
    )


def _repeat(column: str) -> Query:
    return lambda spark, folder: plain(
        measures.repeat_customers(order_lines(spark, folder), ["market"]).select("market", column)
    )


def _segment(column: str) -> Query:
    return lambda spark, folder: plain(
        measures.segment_measures(order_lines(spark, folder), customer_rfm(spark, folder), ["category"]).select(
            "category", column
        )
    )


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    lines = order_lines(spark, folder)
    return cleaning.clean(raw_order_lines(lines), returns_ledger(lines))


def _row_ids(spark: SparkSession, folder: str) -> DataFrame:
    lines = order_lines(spark, folder).select("order_date", "order_id", "product_id", "quantity", "sales")
    return plain(cleaning.assign_row_ids(lines))


def _padded(spark: SparkSession, folder: str) -> DataFrame:
    """Postal codes lose their zeros as numbers and get them back; longer codes keep every digit."""
    code = F.col("postal_code").cast("int").cast("string")
    made = F.when(F.col("customer_id") % 2 == 0, code).otherwise(F.concat(code, F.lit("12345")))
    codes = order_lines(spark, folder).groupBy(made.alias("raw_code")).agg(F.count(F.lit(1)).alias("lines"))
    return codes.withColumn("postal_code", cleaning.pad_postal_code(F.col("raw_code")))


def _scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _load_and_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Replace, then append the same raw table; the audit rows and the stored totals must agree."""
    lines = order_lines(spark, folder)
    raw, returned, place = raw_order_lines(lines), returns_ledger(lines), _scratch(spark, "load")
    for number, replace in enumerate((True, False), 1):
        sinks.load_order_lines(
            raw, f"{place}/table", f"{place}/audit", f"load-{number}", replace=replace, returned_orders=returned
        )
    stored = read_flat(spark, f"{place}/table").agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.sum("sales").cast("double").alias("sales"))
    )
    return (
        sinks.latest_loads(spark, f"{place}/audit")
        .withColumn("stored", stored.scalar())
        .select(
            "filename",
            "total_rows",
            "valid_rows",
            "invalid_rows",
            "status",
            F.col("stored.rows").alias("stored_rows"),
            F.col("stored.sales").alias("stored_sales"),
        )
    )


def _load_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The same raw table appended twice under one name: one audit row, and lines that are stored once."""
    lines = order_lines(spark, folder)
    raw, returned, place = raw_order_lines(lines), returns_ledger(lines), _scratch(spark, "load")
    for _ in range(2):
        sinks.load_order_lines(
            raw, f"{place}/table", f"{place}/audit", "orders", replace=False, returned_orders=returned, load_id=folder
        )
    audit = sinks.latest_loads(spark, f"{place}/audit").select("filename", "total_rows", "valid_rows", "invalid_rows", "status")
    stored = read_flat(spark, f"{place}/table").agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.sum("sales").cast("double").alias("sales"))
    )
    return audit.withColumn("stored", stored.scalar()).select(
        *audit.columns, F.col("stored.rows").alias("stored_rows"), F.col("stored.sales").alias("stored_sales")
    )


def _rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every row a load left out, with its reason and some of its cells."""
    raw, place = raw_order_lines(order_lines(spark, folder)), _scratch(spark, "load")
    sinks.load_order_lines(raw, f"{place}/table", f"{place}/audit", "orders", load_id=folder)
    cells = [F.get_json_object("raw_row", f"$.{c}").alias(c) for c in ("order_id", "product_id", "order_date", "sales")]
    return read_rejected(spark, f"{place}/table").select("reject_reason", *cells)


def _late_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are loaded without their ledger, which comes later and twice; flags and totals by year."""
    lines, place = order_lines(spark, folder), _scratch(spark, "load")
    sinks.load_order_lines(raw_order_lines(lines), f"{place}/table", f"{place}/audit", "orders", load_id=folder)
    for _ in range(2):
        sinks.apply_returns(spark, f"{place}/table", f"{place}/audit", returns_ledger(lines), "ledger", load_id=folder)
    totals = read_flat(spark, f"{place}/table").groupBy("year", "is_returned", "order_status")
    return plain(totals.agg(F.count(F.lit(1)).alias("lines"), F.sum("sales").alias("sales")))


def _cleaned_once(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned lines as a stored table, for reports that scan them more than once."""
    place = _scratch(spark, "load")
    lines = order_lines(spark, folder)
    sinks.load_order_lines(
        raw_order_lines(lines), f"{place}/table", f"{place}/audit", "orders", returned_orders=returns_ledger(lines), load_id=folder
    )
    return read_flat(spark, f"{place}/table")


def _stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files arrive in a folder, a stream cleans and appends them; totals of what it stored."""
    lines, place = order_lines(spark, folder), _scratch(spark, "stream")
    raw = raw_order_lines(lines)
    sinks.write_csv(raw, f"{place}/inbox", compression="gzip")
    arriving = ingest.stream_order_files(spark, f"{place}/inbox", raw.schema)
    ingest.start_ingest(
        arriving, f"{place}/table", f"{place}/audit", f"{place}/progress", returns_ledger(lines)
    ).awaitTermination()
    return plain(
        ingest.read_ingested(spark, f"{place}/table")
        .groupBy("year", "order_status")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"))
    )


def _stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of events that arrive in three drops, each a restart from the checkpoint.

    The first drops are the halves of the time range; the last one brings, long after, every 97th event.
    """
    place = _scratch(spark, "events")
    found = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"
    )
    ends = found.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        F.timestamp_micros(F.expr("unix_micros(a) + (unix_micros(b) - unix_micros(a)) div 2"))
    )
    early, held_back = F.col("ts") < ends.scalar(), F.col("event_id") % 97 == 0
    for drop in (early & ~held_back, ~early & ~held_back, held_back):
        found.where(drop).write.mode("append").parquet(f"{place}/inbox")
        arriving = events.stream_events(spark, f"{place}/inbox")
        for query in events.start_event_windows(arriving, f"{place}/table", f"{place}/progress"):
            query.awaitTermination()
    return events.read_event_windows(spark, f"{place}/table").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "event_type",
        F.col("events").alias("n_events"),
        F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"),
        F.col("late").alias("n_late"),
    )


CLEANING: dict[str, Query] = {
    "clean_order_lines": lambda spark, folder: plain(_cleaned(spark, folder)),
    "clean_stats": lambda spark, folder: cleaning.cleaning_statistics(raw_order_lines(order_lines(spark, folder))),
    "domain_checks": lambda spark, folder: cleaning.domain_violations(_cleaned(spark, folder)),
    "dq_report": on_lines(cleaning.quality_report),
    "dq_report_cleaned": lambda spark, folder: plain(cleaning.quality_report(_cleaned_once(spark, folder))),
    "duplicate_profile": lambda spark, folder: cleaning.duplicate_profile(
        raw_order_lines(order_lines(spark, folder)).select("Order ID", "SKU", "Order Date", "Ship Date", "QTY", "Price")
    ),
    "duplicates_removed": lambda spark, folder: plain(
        cleaning.drop_exact_duplicates(
            order_lines(spark, folder).select("order_id", "category", "ship_mode", "discount")
        )
    ),
    "returned_flag": lambda spark, folder: plain(
        _cleaned(spark, folder)
        .groupBy("is_returned", "order_status")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("sales").alias("sales"))
    ),
    "surrogate_row_ids": _row_ids,
    "load_and_audit": _load_and_audit,
    "load_twice": _load_twice,
    "rejected_rows": _rejected_rows,
    "late_returns": _late_returns,
    "stream_ingest": _stream_ingest,
    "stream_event_windows": _stream_event_windows,
    "postal_codes_padded": _padded,
}


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name, report in (FLAT | SERVICE | EDA).items():
        found[name] = on_lines(report)
    for name, report in STAR.items():
        found[name] = on_star(report)
    found |= CLEANING

    found["filter_context"] = on_lines(service.kpi_summary, filters=SELECTION)
    found["filtered_sales_trend"] = on_lines(service.sales_trend, filters=SELECTION)
    found["filtered_discount_impact"] = on_lines(service.discount_impact, filters=SELECTION)
    found["filtered_rfm_quartiles"] = on_lines(service.rfm_quartiles, filters=SELECTION)
    found["filtered_insights"] = on_lines(service.insights, filters=FilterContext(year=1998))
    found["top_products_by_profit"] = on_lines(service.top_products, sort_by="profit", limit=25)
    found["top_products_by_quantity"] = on_lines(service.top_products, sort_by="quantity", limit=25)
    found["top_customers_50"] = on_lines(service.top_customers, limit=50)
    found["order_ledger_search"] = on_lines(
        service.order_ledger_page, search=" Blue B", sort_by="sales", sort_desc=False, page=3, page_size=50
    )
    found["order_ledger_deep_page"] = on_lines(service.order_ledger_page, page=501, page_size=100)
    found["order_ledger_info"] = on_lines(service.order_ledger_info, search=" Blue B", page=3, page_size=50)

    found["rfm_quartile_scores"] = on_lines(service.rfm_quartile_scores)
    found["rfm_quintiles"] = on_rfm(lambda table: table.drop("rfm_segment"))
    found["rfm_segments_9"] = on_rfm(lambda table: table.select("customer_id", "rfm_score", "rfm_segment"))
    found["rfm_segments_7"] = on_lines(rfm.rfm_seven_segments)
    found["rfm_segment_summary"] = on_rfm(rfm.segment_summary)
    found["customer_highlights"] = on_rfm(rfm.customer_highlights)
    found["rfm_reconcile"] = lambda spark, folder: plain(
        rfm.reconcile(customer_rfm(spark, folder), order_lines(spark, folder))
    )

    found["chart_top_products"] = on_lines(eda.top_names, name="product_name")
    found["chart_top_customers"] = on_lines(eda.top_names, name="customer_name")
    found["forecast"] = on_lines(forecast.forecast)
    found["forecast_profit"] = on_lines(forecast.forecast, metric="profit", horizon=24)
    found["forecast_summary"] = on_lines(forecast.forecast_summary)
    found["forecast_short_history"] = on_lines(
        forecast.forecast, horizon=3, filters=FilterContext(start_date="1997-01-01", end_date="1997-10-31")
    )

    for name in LINE_MEASURES:
        found[f"m_{name}"] = on_lines(measures.line_measure, name=name, by=["market", "category"])
    for name in ("sales_ytd", "profit_ytd", "sales_ly", "profit_ly", "sales_yoy_amt", "sales_yoy_pct", "profit_yoy_pct"):
        found[f"m_{name}"] = _time_measure(name)
    found["m_sales_mtd"] = on_lines(measures.sales_mtd)
    found["m_sales_3m_avg"] = lambda spark, folder: plain(
        measures.sales_3m_average(order_lines(spark, folder), star_tables(spark, folder).date)
    )
    found["m_repeat_customers"] = _repeat("repeat_customers")
    found["m_repeat_rate"] = _repeat("repeat_rate")
    for name in ("champions_sales", "at_risk_sales", "at_risk_profit"):
        found[f"m_{name}"] = _segment(name)
    found["m_top_product_sales"] = on_lines(measures.top_product_sales, by=["category"])
    found["m_on_time_rate"] = on_star(measures.on_time_rate, by=["ship_mode"])
    return found
