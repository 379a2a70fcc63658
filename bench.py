"""Time the headline queries and print one JSON line.

``load`` is the join of the trade tables into the stored order lines, ``segment`` the stored customer
segmentation and ``star`` the stored star schema; every other query reads what these wrote. All of
them count towards the total.
"""

from __future__ import annotations

import json
import os
import time

from catalogue.queries import all_queries
from tallyworks.session import build_session
from tallyworks.sources.flat import customer_rfm, order_lines, star_tables

HEADLINE = [
    "q01_core_kpis",
    "q03_yoy_growth_analysis",
    "q04_monthly_sales_trend",
    "q08_subcategory_performance",
    "q09_top10_products_sales",
    "q12_high_sales_negative_profit",
    "q13_top10_customers_sales",
    "q15_customer_pareto_distribution",
    "q18_customer_segment_performance",
    "q20_discount_bands_profitability",
    "q23_customer_repeat_buyer_cohorts",
    "kpi_summary",
    "sales_trend",
    "customer_performance",
    "rfm_quartiles",
    "discount_impact",
    "order_ledger_page",
    "order_ledger_deep_page",
    "insights",
    "filter_options",
    "star_category_matrix",
    "star_top_products",
    "basket_pairs",
    "rfm_ntile",
    "acquisition_cohorts",
    "rfm_segment_summary",
    "correlation_matrix",
    "iqr_outliers",
    "forecast",
    "clean_order_lines",
    "dq_report",
    "dq_report_cleaned",
    "load_and_audit",
    "load_twice",
    "late_returns",
    "stream_event_windows",
    "m_sales_yoy_pct",
    "m_on_time_rate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            # Small data: pieces of a few megabytes keep all local threads at work.
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().count()  # start the workers before the clock

    taken: dict[str, float] = {}

    def timed(name: str, work) -> None:
        began = time.perf_counter()
        work()
        taken[name] = round(time.perf_counter() - began, 3)

    timed("load", lambda: order_lines(spark, folder))
    timed("segment", lambda: customer_rfm(spark, folder))
    timed("star", lambda: star_tables(spark, folder))
    queries = all_queries()
    for name in HEADLINE:
        # A noop write computes every row and column without moving results to the driver.
        timed(name, lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
