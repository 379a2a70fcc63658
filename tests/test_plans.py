"""Properties of the physical plans that must hold at any scale."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from catalogue.queries import EDA, FLAT, SERVICE, STAR, all_queries
from tallyworks.operators.filters import FilterContext
from tallyworks.plans import flat_suite, service
from tallyworks.sources.flat import order_lines, star_tables
from tallyworks.sources.tables import derive_order_lines

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(FLAT | STAR | SERVICE | EDA))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(all_queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "Python"):
        assert bad not in plan


def test_reports_read_only_their_columns(spark):
    plan = plan_of(flat_suite.sales_profit_by_year(order_lines(spark, FOLDER)))
    schema = plan[plan.index("ReadSchema:") :].split("\n")[0]
    assert set(re.findall(r"(\w+):", schema.split("struct")[1])) == {"order_id", "sales", "quantity", "profit"}


def test_filters_reach_the_scan(spark):
    context = FilterContext(year=1996, market="ASIA", start_date="1996-02-01")
    plan = plan_of(service.kpi_summary(order_lines(spark, FOLDER), context))
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "EqualTo(market,ASIA)" in plan and "GreaterThanOrEqual(order_date,1996-02-01)" in plan


def test_top_k_is_not_a_full_sort(spark):
    plan = plan_of(service.top_products(order_lines(spark, FOLDER)))
    assert "TakeOrderedAndProject" in plan


def test_hot_join_keys_are_split(spark):
    """A third of all lines in one order and a third in one product."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for table in ("orders", "customer", "nation", "region", "part"):
        os.symlink(f"/root/testdata/sf0.01/{table}.parquet", f"{folder}/{table}.parquet")
    third = F.col("l_linenumber") % 3
    (
        spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
        .withColumn("l_partkey", F.when(third == 0, 5).otherwise(F.col("l_partkey")))
        .withColumn("l_orderkey", F.when(third == 1, 8).otherwise(F.col("l_orderkey")))
        .repartition(8)
        .write.parquet(f"{folder}/lineitem.parquet")
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        totals = derive_order_lines(spark, folder).groupBy("category").agg(F.sum("profit"), F.count(F.lit(1)))
        assert sum(row[2] for row in totals.collect()) == 60_000
        assert plan_of(totals).count("SortMergeJoin(skew=true)") >= 2
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_lines_are_moved_only_for_their_joins(spark):
    """Lines meet their parts first, narrow, then their orders; nothing is laid out again after that."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        plan = plan_of(derive_order_lines(spark, FOLDER))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "REBALANCE" not in plan
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
    assert "l_orderkey" in joins[0] and "l_partkey" in joins[1]  # the last join comes first


def test_stored_tables_are_small(spark):
    """Order lines and facts: whole, by year, zstd."""
    lines, star = order_lines(spark, FOLDER), star_tables(spark, FOLDER)
    count = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    for table, year in ((lines, "year"), (star.fact, "order_year")):
        assert table.count() == count
        assert all(name.endswith(".zstd.parquet") and f"/{year}=" in name for name in table.inputFiles())
