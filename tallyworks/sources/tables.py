"""Order lines from normalised trade tables (orders, lineitem, customer, nation, region, part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.expr import calendar_columns, line_flags, ratio, round_scaled


# The columns that are read, by table. Given types spare one job per table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _shifted(whole: Column, digits: int, kind: str) -> Column:
    """A whole number of units of 10^-digits as a decimal, without going through text."""
    unit = F.lit("0." + "0" * (digits - 1) + "1").cast(f"decimal({digits},{digits})")
    return (whole.cast("bigint").cast("decimal(14,0)") * unit).cast(kind)


def join_order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The flat order-line shape, before calendar and flag columns.

    Small sides are broadcast by Spark when their size allows it; the other joins are hash or
    sort-merge joins whose hot keys are split by adaptive execution. Lines meet their parts while they are
    narrow, and orders, with their customers, last: lines of an order then lie side by side, so that their common
    cells compress well, and nothing is moved after the joins.
    """
    nation = _table(spark, folder, "nation").join(
        _table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    buyers = _table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = _table(spark, folder, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    parts = _table(spark, folder, "part")
    joined = (
        _table(spark, folder, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )

    mode = F.col("o_orderkey") % 4
    steps = F.rint(F.col("l_discount") * 100).cast("int")
    eaten = steps * steps * 8
    rate = _shifted(F.lit(290) + (F.col("p_size") - 25) * 4 - eaten, 3, "decimal(5,3)")
    return (
        joined.withColumns(
            {
                "sales": _shifted(F.rint(F.col("l_extendedprice") * 100), 2, "decimal(12,2)"),
                "tax": _shifted(F.rint(F.col("l_tax") * 100), 2, "decimal(4,2)"),
            }
        )
        .select(
            F.col("o_orderkey").cast("bigint").alias("order_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("l_shipdate").cast("date").alias("raw_ship_date"),
            F.when(mode == 0, "Same Day")
            .when(mode == 1, "First Class")
            .when(mode == 2, "Second Class")
            .otherwise("Standard Class")
            .alias("ship_mode"),
            (F.when(mode == 0, 0).when(mode == 1, 1).when(mode == 2, 2).otherwise(4) + F.col("l_linenumber") % 4)
            .cast("int")
            .alias("shipping_days"),
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("country"),
            F.concat(F.col("n_name"), F.lit("/"), (F.col("c_custkey") % 20).cast("int")).alias("city"),
            F.concat(F.col("n_name"), F.lit("/"), (F.col("c_custkey") % 4).cast("int")).alias("state"),
            F.lpad((F.col("n_nationkey") * 20 + F.col("c_custkey") % 20).cast("string"), 5, "0").alias("postal_code"),
            F.col("r_name").alias("market"),
            F.concat(F.col("r_name"), F.lit("-"), (F.col("n_nationkey") % 3).cast("int")).alias("region"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("sub_category"),
            F.col("p_name").alias("product_name"),
            "sales",
            F.col("l_quantity").cast("int").alias("quantity"),
            _shifted(eaten, 3, "decimal(7,3)").alias("discount"),
            (F.col("sales") * rate).cast("decimal(14,4)").alias("profit"),
            (F.col("sales") * F.col("tax")).cast("decimal(14,4)").alias("shipping_cost"),
            F.col("o_orderpriority").alias("order_priority"),
            ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0)).alias("is_returned"),
        )
        .withColumn("ship_date", F.date_add("order_date", F.col("shipping_days")))
        .withColumn("unit_price", round_scaled(ratio("sales", "quantity"), 2))
    )


def derive_order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All order lines with calendar and flag columns."""
    return join_order_lines(spark, folder).withColumns(line_flags()).withColumns(calendar_columns("order_date"))
