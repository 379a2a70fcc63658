"""Monthly forecast: straight-line trend plus additive seasonal means, with 95 percent bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.expr import labelled, round_half_even
from tallyworks.operators.filters import EVERYTHING, FilterContext

# Fixed values of the method.
MIN_MONTHS = 6
Z = 1.96
WIDENING = 0.15
NO_FLOOR = -1e9


def _history(lines: DataFrame, metric: str, filters: FilterContext) -> DataFrame:
    """One row per month with its trend, seasonal mean and fitted value. All windows run over months."""
    months = (
        filters.apply(lines)
        .groupBy("year_month")
        .agg(F.sum(metric).cast("double").alias("actual"))
        .withColumn("t", F.row_number().over(Window.orderBy("year_month")) - 1)
    )
    every = Window.partitionBy()
    n = F.count(F.lit(1)).over(every)
    fitted = months.withColumns(
        {
            "n": n,
            "slope": F.regr_slope("actual", "t").over(every),
            "intercept": F.regr_intercept("actual", "t").over(every),
        }
    ).filter(F.col("n") >= MIN_MONTHS)
    trend = F.col("intercept") + F.col("slope") * F.col("t")
    period = labelled([(F.col("n") >= 18, F.lit(12)), (F.col("n") >= 8, F.lit(4))], F.lit(2))
    seasonal = F.avg(F.col("actual") - F.col("trend")).over(Window.partitionBy("season"))
    return (
        fitted.withColumn("trend", trend)
        .withColumn("period", period)
        .withColumn("season", F.col("t") % F.col("period"))
        .withColumn("seasonal", seasonal)
        .withColumn("fitted", F.col("trend") + F.col("seasonal"))
        .withColumn("residual", F.col("actual") - F.col("fitted"))
    )


def _model(history: DataFrame) -> DataFrame:
    """One row: errors, spread, and the seasonal means by season."""
    spread = F.stddev_pop("residual")
    return history.agg(
        F.max("n").alias("n"),
        F.max("period").alias("period"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.max("year_month").alias("last_month"),
        F.avg(F.abs("residual")).alias("mae"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        F.when(spread > 0, spread).otherwise(F.avg("actual") * 0.1).alias("spread"),
        # At most twelve entries.
        F.sort_array(F.collect_set(F.struct("season", "seasonal"))).alias("seasons"),
    ).filter(F.col("n").isNotNull())


def _floor(metric: str) -> Column:
    return F.lit(0.0) if metric == "sales" else F.lit(NO_FLOOR)


def forecast(
    lines: DataFrame, metric: str = "sales", horizon: int = 6, filters: FilterContext = EVERYTHING
) -> DataFrame:
    """Fitted history followed by ``horizon`` future months; empty when there are too few months."""
    if metric not in ("sales", "profit"):
        raise ValueError("metric must be sales or profit")
    if not 1 <= horizon <= 24:
        raise ValueError("horizon must be between 1 and 24")
    history = _history(lines, metric, filters)
    model = _model(history)
    floor = _floor(metric)

    spread = model.select("spread").scalar()
    past = history.select(
        F.col("year_month").alias("period"),
        round_half_even("actual", 2).alias("actual"),
        round_half_even("fitted", 2).alias("forecast"),
        round_half_even(F.greatest(floor, F.col("fitted") - Z * spread), 2).alias("lower_bound"),
        round_half_even(F.col("fitted") + Z * spread, 2).alias("upper_bound"),
    )

    step = F.col("step")
    t = F.col("n") + step
    season = F.element_at("seasons", (t % F.col("period") + 1).cast("int")).getField("seasonal")
    raw = F.col("intercept") + F.col("slope") * t + season
    expected = F.greatest(floor, raw) if metric == "sales" else raw
    margin = Z * F.col("spread") * F.sqrt(1 + step * WIDENING)
    future = (
        model.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
        .withColumn("expected", expected)
        .withColumn("margin", margin)
        .select(
            F.date_format(F.add_months(F.to_date(F.concat("last_month", F.lit("-01"))), step + 1), "yyyy-MM").alias(
                "period"
            ),
            F.lit(None).cast("double").alias("actual"),
            round_half_even("expected", 2).alias("forecast"),
            round_half_even(F.greatest(floor, F.col("expected") - F.col("margin")), 2).alias("lower_bound"),
            round_half_even(F.col("expected") + F.col("margin"), 2).alias("upper_bound"),
        )
    )
    return past.unionByName(future).orderBy("period")


def forecast_summary(
    lines: DataFrame, metric: str = "sales", horizon: int = 6, filters: FilterContext = EVERYTHING
) -> DataFrame:
    """Model name, number of months and errors; a baseline with zero errors when months are too few."""
    months = filters.apply(lines).agg(F.count_distinct("year_month").alias("historical_count"))
    errors = _model(_history(lines, metric, filters)).select(
        F.struct(round_half_even("mae", 2).alias("mae"), round_half_even("rmse", 2).alias("rmse"))
    )
    enough = F.col("historical_count") >= MIN_MONTHS
    return months.withColumn("errors", errors.scalar()).select(
        F.lit(metric).alias("metric"),
        F.lit(horizon).alias("horizon_months"),
        # Model names as published.
        F.when(enough, "Additive Holt-Winters & Linear Trend Decomposition")
        .otherwise("Moving Average Baseline")
        .alias("model_name"),
        "historical_count",
        F.coalesce("errors.mae", F.lit(0.0)).alias("mae"),
        F.coalesce("errors.rmse", F.lit(0.0)).alias("rmse"),
    )
