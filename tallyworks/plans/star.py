"""The star schema: five dimensions and one fact table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyworks.functions.expr import money
from tallyworks.session import open_writers
from tallyworks.sources.schema import COMPRESSION

# Shipping modes and their service targets.
SHIPPING_MODES = [
    (1, "Same Day", 1, "Express Same Day"),
    (2, "First Class", 2, "Expedited Air"),
    (3, "Second Class", 3, "Priority Ground"),
    (4, "Standard Class", 6, "Standard Freight"),
]

FACT_COLUMNS = [
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "postal_code", "product_id",
    "sales", "quantity", "discount", "profit", "shipping_days", "profit_margin",
]


def _first_by(lines: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row per key with the attributes it had first; on the same day, the least attributes win.

    Equal (key, attributes) rows are merged first, by hash and on the map side, so a hot key reaches
    the second step as few rows.
    """
    seen = lines.groupBy(key, *attributes).agg(F.min("order_date").alias("seen"))
    first = F.min_by(F.struct(*attributes), F.struct("seen", *attributes)).alias("first")
    return seen.groupBy(key).agg(first).select(key, "first.*")


def dim_customer(lines: DataFrame, rfm: DataFrame | None = None) -> DataFrame:
    """Unique customers, with segmentation attributes where ``rfm`` is given."""
    customers = _first_by(lines, "customer_id", ["customer_name", "segment"])
    if rfm is None:
        return customers
    attributes = ["recency", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "rfm_segment"]
    # An id with several names or segments has several scores: those of its largest spend count.
    place = F.struct("monetary", "customer_name", "segment")
    one = rfm.groupBy("customer_id").agg(F.max_by(F.struct(*attributes), place).alias("best"))
    return customers.join(one.select("customer_id", "best.*"), "customer_id", "left")


def dim_product(lines: DataFrame) -> DataFrame:
    return _first_by(lines, "product_id", ["category", "sub_category", "product_name"])


def dim_geography(lines: DataFrame) -> DataFrame:
    return _first_by(lines, "postal_code", ["city", "state", "region", "country"])


def dim_shipping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SHIPPING_MODES, "ship_mode_id int, ship_mode string, sla_target_days int, delivery_tier string"
    )


def dim_date(lines: DataFrame) -> DataFrame:
    """Every day from the first order to the last order or shipment."""
    bounds = lines.agg(
        F.min("order_date").alias("first"), F.greatest(F.max("order_date"), F.max("ship_date")).alias("last")
    )
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
    day = F.col("date")
    quarter = F.concat(F.lit("Q"), F.quarter(day))
    return days.select(
        "date",
        date_key(day).alias("date_key"),
        F.year(day).alias("year"),
        quarter.alias("quarter"),
        F.concat_ws("-", F.year(day).cast("string"), quarter).alias("year_quarter"),
        F.month(day).alias("month_number"),
        F.date_format(day, "MMMM").alias("month"),
        F.date_format(day, "MMM").alias("month_short"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.weekofyear(day).alias("week_number"),
        F.dayofmonth(day).alias("day"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        (F.weekday(day) + 1).alias("day_of_week_num"),
        (F.weekday(day) >= 5).cast("int").alias("is_weekend"),
    )


def date_key(day):
    return F.date_format(day, "yyyyMMdd").cast("int")


def fact_sales(lines: DataFrame) -> DataFrame:
    """Lines with integer keys. The four shipping modes are the only broadcast side."""
    modes = dim_shipping(lines.sparkSession).select("ship_mode", "ship_mode_id")
    row_id = ["row_id"] if "row_id" in lines.columns else []
    return (
        lines.select(*row_id, *FACT_COLUMNS)
        .join(F.broadcast(modes), "ship_mode", "left")
        .select(
            *row_id,
            *FACT_COLUMNS,
            "ship_mode_id",
            date_key("order_date").alias("order_date_key"),
            date_key("ship_date").alias("ship_date_key"),
        )
    )


@dataclasses.dataclass(frozen=True)
class StarTables:
    fact: DataFrame
    customer: DataFrame
    product: DataFrame
    geography: DataFrame
    shipping: DataFrame
    date: DataFrame


def build_star(lines: DataFrame, rfm: DataFrame | None = None) -> StarTables:
    return StarTables(
        fact=fact_sales(lines),
        customer=dim_customer(lines, rfm),
        product=dim_product(lines),
        geography=dim_geography(lines),
        shipping=dim_shipping(lines.sparkSession),
        date=dim_date(lines),
    )


def write_star(star: StarTables, path: str) -> dict[str, StructType]:
    """One Parquet table per dimension, and the fact by order year. Returns the stored schemas.

    Stored lines lie by year already, so a task that reads them has few years, and the fact is written as it is read.
    """
    schemas = {}
    for field in dataclasses.fields(star):
        table = getattr(star, field.name)
        if field.name == "fact":
            table = table.withColumn("order_year", F.year("order_date"))
            writer = table.write.partitionBy("order_year")
        else:
            writer = table.write
        with open_writers(table.sparkSession):
            writer.mode("overwrite").option("compression", COMPRESSION).parquet(f"{path}/{field.name}")
        schemas[field.name] = table.schema
    return schemas


def read_star(spark: SparkSession, path: str, schemas: dict[str, StructType] | None = None) -> StarTables:
    """Known schemas spare the jobs that read them from files."""
    tables = {}
    for field in dataclasses.fields(StarTables):
        reader = spark.read.schema(schemas[field.name]) if schemas else spark.read
        tables[field.name] = reader.parquet(f"{path}/{field.name}")
    return StarTables(**tables)


def shipping_usage(tables: StarTables) -> DataFrame:
    """The shipping modes that order lines use, with the lines and the longest delivery of each."""
    used = tables.fact.groupBy("ship_mode_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.max("shipping_days").cast("int").alias("slowest_days")
    )
    return tables.shipping.join(used, "ship_mode_id").select(*tables.shipping.columns, "line_count", "slowest_days")


def sales_by_ship_month(star: StarTables) -> DataFrame:
    """The shipping role of the date dimension: facts joined on the ship date key."""
    calendar = star.date.select("date_key", "year_month")
    return (
        star.fact.groupBy("ship_date_key")
        .agg(F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"))
        .join(calendar, F.col("ship_date_key") == F.col("date_key"))
        .groupBy(F.col("year_month").alias("ship_year_month"))
        .agg(money(F.sum("sales")).alias("total_sales"), F.sum("quantity").alias("units_shipped"))
        .orderBy("ship_year_month")
    )
