from __future__ import annotations

from catalogue.sql.base import ORDERS, double, mean, money, query, ratio, total, whole
from catalogue.sql.rfm import QUINTILES
from catalogue.sql.star import CALENDAR


def or_zero(a: str, b: str, digits: int = 6) -> str:
    return f"HALF_UP(COALESCE({ratio(a, b)}, 0.0), {digits})"


def some(column: str, where: str) -> str:
    return f"COALESCE({money(f'SUM({column}) FILTER ({where})')}, 0.0)"


LINE = {
    "total_sales": total("sales"),
    "total_profit": total("profit"),
    "profit_margin": or_zero("SUM(profit)", "SUM(sales)"),
    "total_quantity": whole("SUM(quantity)"),
    "total_orders": ORDERS,
    "total_customers": "COUNT(DISTINCT customer_id)",
    "aov": or_zero("SUM(sales)", ORDERS, 2),
    "total_cost": money("SUM(sales - profit)"),
    "avg_discount_simple": f"HALF_UP({mean('discount')}, 6)",
    "avg_discount_weighted": or_zero("SUM(sales * discount)", "SUM(sales)"),
    "avg_ship_days": f"HALF_UP({mean('shipping_days')}, 6)",
    "sales_per_customer": or_zero("SUM(sales)", "COUNT(DISTINCT customer_id)", 2),
    "loss_sales": some("sales", "profit < 0"),
    "unprofitable_loss": some("profit", "profit < 0"),
    "loss_line_rate": or_zero("COUNT(*) FILTER (profit < 0)", "COUNT(*)"),
    "heavy_discount_sales": some("sales", "discount > 0.50"),
    "heavy_discount_sales_20": some("sales", "discount > 0.20"),
    "delayed_order_rate": or_zero("COUNT(DISTINCT order_id) FILTER (shipping_days > 5)", ORDERS),
}

MONTHS = """
  months AS (SELECT year, month, year_month, SUM(sales) AS s, SUM(profit) AS p FROM sales GROUP BY year, month, year_month),
  looked AS (
    SELECT a.*, b.s AS sb, b.p AS pb, SUM(a.s) OVER (PARTITION BY a.year ORDER BY a.month) AS sy,
      SUM(a.p) OVER (PARTITION BY a.year ORDER BY a.month) AS py
    FROM months a LEFT JOIN months b ON b.year = a.year - 1 AND b.month = a.month)"""

TIME = {
    "sales_ytd": money("sy"),
    "profit_ytd": money("py"),
    "sales_ly": money("sb"),
    "profit_ly": money("pb"),
    "sales_yoy_amt": money("s - COALESCE(sb, 0)"),
    "sales_yoy_pct": or_zero("s - sb", "sb"),
    "profit_yoy_pct": or_zero("p - pb", "pb"),
}

REPEAT = """
  buyers AS (SELECT market, customer_id, COUNT(DISTINCT order_id) AS orders FROM sales GROUP BY market, customer_id)"""

SEGMENTED = {
    "champions_sales": some("sales", "rfm_segment = 'Champions'"),
    "at_risk_sales": some("sales", "rfm_segment = 'At Risk'"),
    "at_risk_profit": some("profit", "rfm_segment = 'At Risk'"),
}

SQL = {
    f"m_{name}": query(f"SELECT market, category, {formula} AS {name} FROM sales GROUP BY market, category")
    for name, formula in LINE.items()
}
SQL |= {f"m_{name}": query(f"SELECT year_month, {formula} AS {name} FROM looked", MONTHS) for name, formula in TIME.items()}
SQL |= {
    f"m_{name}": query(
        f"SELECT category, {formula} AS {name} FROM tagged GROUP BY category",
        QUINTILES,
        """tagged AS (SELECT sales.category, sales.sales, sales.profit, quintiles.rfm_segment
             FROM sales JOIN quintiles USING (customer_id))""",
    )
    for name, formula in SEGMENTED.items()
}
SQL |= {
    "m_sales_mtd": query(f"""
      SELECT CAST(order_date AS VARCHAR) AS order_date, {money('s')} AS total_sales,
        {money('SUM(s) OVER (PARTITION BY ym ORDER BY order_date)')} AS sales_mtd
      FROM (SELECT order_date, year_month AS ym, SUM(sales) AS s FROM sales GROUP BY order_date, year_month) d"""),
    "m_sales_3m_avg": query(
        f"""SELECT ends.ym AS year_month, HALF_UP({ratio('SUM(days.s)', 'COUNT(*)')}, 2) AS sales_3m_daily_avg,
              (SELECT HALF_UP({ratio('SUM(t.s)', 'COUNT(*)')}, 2)
               FROM (SELECT ym, SUM(s) AS s FROM days WHERE days.ym <= ends.ym GROUP BY ym ORDER BY ym DESC LIMIT 3) t
               WHERE ends.ym IN (SELECT ym FROM days)) AS sales_3m_monthly_avg
            FROM ends JOIN days ON days.order_date <= ends.last_date AND days.order_date > ends.last_date - INTERVAL 3 MONTH
            GROUP BY ends.ym""",
        CALENDAR,
        "days AS (SELECT order_date, year_month AS ym, SUM(sales) AS s FROM sales GROUP BY order_date, year_month)",
        "ends AS (SELECT STRFTIME(d, '%Y-%m') AS ym, MAX(d) AS last_date FROM calendar GROUP BY 1)",
    ),
    "m_repeat_customers": query(
        "SELECT market, COUNT(*) FILTER (orders > 1) AS repeat_customers FROM buyers GROUP BY market", REPEAT
    ),
    "m_repeat_rate": query(
        f"SELECT market, {or_zero('COUNT(*) FILTER (orders > 1)', 'COUNT(*)')} AS repeat_rate FROM buyers GROUP BY market",
        REPEAT,
    ),
    "m_top_product_sales": query(f"""
      SELECT category, {money('MAX(s)')} AS top_product_sales
      FROM (SELECT category, product_name, SUM(sales) AS s FROM sales GROUP BY category, product_name) GROUP BY category"""),
    "m_on_time_rate": query(f"""
      SELECT ship_mode, {or_zero("COUNT(*) FILTER (shipping_days <= CASE ship_mode WHEN 'Same Day' THEN 1 "
        "WHEN 'First Class' THEN 2 WHEN 'Second Class' THEN 3 ELSE 6 END)", 'COUNT(*)')} AS on_time_rate
      FROM sales GROUP BY ship_mode"""),
}


def forecast(metric: str, horizon: int, where: str = "TRUE") -> str:
    floor = "0.0" if metric == "sales" else "-1e9"
    lowered = "GREATEST(0.0, raw)" if metric == "sales" else "raw"
    return query(
        f"""
        SELECT ym AS period, HALF_EVEN(actual, 2) AS actual, HALF_EVEN(fitted, 2) AS forecast,
          HALF_EVEN(GREATEST({floor}, fitted - 1.96 * spread), 2) AS lower_bound, HALF_EVEN(fitted + 1.96 * spread, 2) AS upper_bound
        FROM fits, model
        UNION ALL
        SELECT STRFTIME(STRPTIME(last_ym || '-01', '%Y-%m-%d') + TO_MONTHS(CAST(step + 1 AS INTEGER)), '%Y-%m'), NULL,
          HALF_EVEN(expected, 2), HALF_EVEN(GREATEST({floor}, expected - margin), 2), HALF_EVEN(expected + margin, 2)
        FROM (SELECT *, {lowered} AS expected, 1.96 * spread * SQRT(1 + step * 0.15) AS margin
              FROM (SELECT step, model.*, intercept + slope * (n + step) + seasonal AS raw
                    FROM RANGE(0, {horizon}) r(step), model,
                      (SELECT DISTINCT season, seasonal FROM fits) s
                    WHERE s.season = (n + step) % period))""",
        *forecast_parts(metric, where),
    )


def forecast_parts(metric: str, where: str) -> list[str]:
    return [
        f"""history AS (SELECT year_month AS ym, {double(f'SUM({metric})')} AS actual FROM sales WHERE {where} GROUP BY year_month)""",
        "timed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ym) - 1 AS t, COUNT(*) OVER () AS n FROM history)",
        """line AS (SELECT REGR_SLOPE(actual, t) AS slope, REGR_INTERCEPT(actual, t) AS intercept, MAX(n) AS months,
             CASE WHEN MAX(n) >= 18 THEN 12 WHEN MAX(n) >= 8 THEN 4 ELSE 2 END AS period FROM timed)""",
        """detrended AS (SELECT timed.*, slope, intercept, period, t % period AS season, intercept + slope * t AS trend
             FROM timed, line WHERE months >= 6)""",
        "seasoned AS (SELECT *, AVG(actual - trend) OVER (PARTITION BY season) AS seasonal FROM detrended)",
        "fits AS (SELECT *, trend + seasonal AS fitted, actual - trend - seasonal AS residual FROM seasoned)",
        """model AS (SELECT MAX(n) AS n, MAX(period) AS period, MAX(slope) AS slope, MAX(intercept) AS intercept,
             MAX(ym) AS last_ym, AVG(ABS(residual)) AS mae, SQRT(AVG(residual * residual)) AS rmse,
             CASE WHEN STDDEV_POP(residual) > 0 THEN STDDEV_POP(residual) ELSE AVG(actual) * 0.1 END AS spread
             FROM fits HAVING COUNT(*) > 0)""",
    ]


SQL |= {
    "forecast": forecast("sales", 6),
    "forecast_profit": forecast("profit", 24),
    "forecast_short_history": forecast("sales", 3, "order_date BETWEEN DATE '1997-01-01' AND DATE '1997-10-31'"),
    "forecast_summary": query(
        """SELECT 'sales' AS metric, 6 AS horizon_months, 'Additive Holt-Winters & Linear Trend Decomposition' AS model_name,
             n AS historical_count, HALF_EVEN(mae, 2) AS mae, HALF_EVEN(rmse, 2) AS rmse FROM model""",
        *forecast_parts("sales", "TRUE"),
    ),
}
