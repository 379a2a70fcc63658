from __future__ import annotations

from catalogue.sql.base import ORDERS, double, mean, money, pct, query, ratio, total, whole

SUMS = f"{total('sales')} AS sales, {total('profit')} AS profit"
MARGIN = pct("SUM(sales.profit)", "SUM(sales.sales)", 4) + " AS profit_margin"
UNITS = f"{whole('SUM(quantity)')} AS quantity"
COUNT = f"{ORDERS} AS orders"
SHARES = f"""{pct('SUM(sales.sales)', '(SELECT SUM(sales) FROM sales)', 4)} AS sales_share,
  {pct('SUM(sales.profit)', '(SELECT SUM(profit) FROM sales)', 4)} AS profit_share"""
PRODUCT = "product_id, product_name, category, sub_category"


def growth(value: str) -> str:
    now = double(f"SUM(sales.{value})")
    before = f"LAG({now}) OVER (ORDER BY year)"
    return f"HALF_UP(({now} - {before}) / {before} * 100, 4) AS yoy_{value}_growth"


def extreme(name: str, order: str) -> str:
    return f"""(SELECT '{name}' AS list, {PRODUCT}, {SUMS}, {UNITS}, {MARGIN} FROM sales GROUP BY {PRODUCT}
      ORDER BY {order}, product_id LIMIT 10)"""


STATE = f"state, region, {SUMS}, {MARGIN}, HALF_UP({mean('discount')} * 100, 4) AS avg_discount_pct"
CORRELATED = ["sales", "quantity", "discount", "profit", "shipping_days"]
OUTLIERS = ["sales", "quantity", "discount", "profit"]


def correlation(a: str, b: str) -> str:
    value = "1.0" if a == b else f"HALF_UP(CORR({double(f'sales.{a}')}, {double(f'sales.{b}')}), 6)"
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({value} AS DOUBLE) AS correlation FROM sales" + (
        " LIMIT 1" if a == b else ""
    )


def outliers(c: str) -> str:
    value = double(f"sales.{c}")
    return f"""
      SELECT '{c}' AS column_name, COUNT(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers,
        HALF_UP(MAX(q1 - 1.5 * (q3 - q1)), 2) AS lower_bound, HALF_UP(MAX(q3 + 1.5 * (q3 - q1)), 2) AS upper_bound,
        HALF_UP(MIN(v), 2) AS min_value, HALF_UP(MAX(v), 2) AS max_value
      FROM (SELECT {value} AS v FROM sales),
        (SELECT QUANTILE_CONT({value}, 0.25) AS q1, QUANTILE_CONT({value}, 0.75) AS q3 FROM sales)"""


def top_names(name: str) -> str:
    return query(
        f"SELECT {name}, {total('sales')} AS sales FROM sales GROUP BY {name} ORDER BY SUM(sales.sales) DESC, {name} LIMIT 10"
    )


MONTHLY = f"SELECT year_month, {SUMS}, {COUNT}, {MARGIN} FROM sales GROUP BY year_month"

SQL = {
    "eda_overview": query(f"""
      SELECT {total('sales')} AS total_sales, {total('profit')} AS total_profit, {whole('SUM(quantity)')} AS total_quantity,
        {ORDERS} AS total_orders, HALF_UP({ratio('SUM(sales)', ORDERS)}, 2) AS average_order_value,
        {pct('SUM(profit)', 'SUM(sales)')} AS profit_margin, HALF_UP({mean('discount')} * 100, 2) AS average_discount,
        HALF_UP({mean('shipping_days')}, 2) AS average_shipping_days
      FROM sales"""),
    "eda_yearly": query(f"""
      SELECT year, {SUMS}, {UNITS}, {COUNT}, {MARGIN}, {growth('sales')}, {growth('profit')} FROM sales GROUP BY year"""),
    "eda_monthly": query(MONTHLY),
    "eda_top_months": query(f"SELECT * FROM ({MONTHLY}) ORDER BY sales DESC, year_month LIMIT 5"),
    "eda_seasonality": query(f"""
      SELECT LEFT(month_name, 3) AS month_name, sales.month AS month_number, {SUMS}, {COUNT} FROM sales
      GROUP BY sales.month, sales.month_name"""),
    "eda_quarterly": query(f"SELECT year, quarter, {SUMS} FROM sales GROUP BY year, quarter"),
    "eda_category": query(f"SELECT category, {SUMS}, {UNITS}, {COUNT}, {MARGIN}, {SHARES} FROM sales GROUP BY category"),
    "eda_subcategory": query(
        f"SELECT category, sub_category, {SUMS}, {UNITS}, {COUNT}, {MARGIN} FROM sales GROUP BY category, sub_category"
    ),
    "eda_loss_subcats": query(
        f"SELECT sub_category, category, {SUMS}, {MARGIN} FROM sales GROUP BY ALL HAVING SUM(sales.profit) < 0"
    ),
    "eda_products": query(
        " UNION ALL ".join(
            [
                extreme("top_by_sales", "SUM(sales.sales) DESC"),
                extreme("top_by_profit", "SUM(sales.profit) DESC"),
                extreme("bottom_by_profit", "SUM(sales.profit)"),
            ]
        )
    ),
    "eda_high_sales_loss": query(f"""
      SELECT product_id, product_name, {SUMS}, {MARGIN} FROM sales GROUP BY {PRODUCT}
      HAVING SUM(sales.sales) > 3000 AND SUM(sales.profit) < 0"""),
    "eda_customers": query(
        f"""SELECT COUNT(*) AS total_customers, HALF_UP({ratio('SUM(s)', 'COUNT(*)')}, 2) AS avg_sales_per_customer,
              HALF_UP({ratio('SUM(p)', 'COUNT(*)')}, 2) AS avg_profit_per_customer,
              {pct('SUM(s) FILTER (place <= 10)', 'SUM(s)')} AS top10_contribution_pct,
              {money('SUM(s) FILTER (place <= 10)')} AS top10_sales, {whole('FLOOR(COUNT(*) * 0.2)')} AS top20pct_customers,
              {pct('SUM(s) FILTER (place <= FLOOR(n * 0.2))', 'SUM(s)')} AS top20pct_contribution_pct,
              {money('SUM(s) FILTER (place <= FLOOR(n * 0.2))')} AS top20pct_sales
            FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY s DESC, customer_id) AS place, COUNT(*) OVER () AS n FROM spend)""",
        "spend AS (SELECT customer_id, SUM(sales) AS s, SUM(profit) AS p FROM sales GROUP BY customer_id)",
    ),
    "eda_segments": query(f"""
      SELECT segment, {SUMS}, {UNITS}, {COUNT}, COUNT(DISTINCT customer_id) AS customers, {MARGIN}, {SHARES}
      FROM sales GROUP BY segment"""),
    "eda_regions": query(f"SELECT region, {SUMS}, {COUNT}, {MARGIN} FROM sales GROUP BY region"),
    "eda_states": query(
        f"""(SELECT 'top_by_profit' AS list, {STATE} FROM sales GROUP BY state, region
              ORDER BY SUM(sales.profit) DESC, state, region LIMIT 5)
            UNION ALL (SELECT 'bottom_by_profit', {STATE} FROM sales GROUP BY state, region
              ORDER BY SUM(sales.profit), state, region LIMIT 5)
            UNION ALL (SELECT 'loss_making', {STATE} FROM sales GROUP BY state, region HAVING SUM(sales.profit) < 0)"""
    ),
    "discount_exact": query(f"""
      SELECT {double('discount')} AS discount, COUNT(*) AS transaction_count, {total('sales')} AS total_sales,
        {total('profit')} AS total_profit, HALF_UP({ratio('SUM(profit)', 'COUNT(*)')}, 4) AS avg_profit_per_order, {MARGIN}
      FROM sales GROUP BY sales.discount"""),
    "discount_rounded": query(f"""
      SELECT CAST(SCALED({double('discount')} * 100, 0) AS INTEGER) AS discount_pct, COUNT(*) AS sales_count,
        {total('sales')} AS sales, HALF_UP({mean('sales.sales')}, 4) AS sales_mean, {total('profit')} AS profit,
        HALF_UP({mean('sales.profit')}, 4) AS profit_mean,
        HALF_UP({mean('CAST(sales.profit_margin AS DECIMAL(12,4))')}, 4) AS margin_mean
      FROM sales GROUP BY 1"""),
    "correlation_matrix": query(" UNION ALL ".join(f"({correlation(a, b)})" for a in CORRELATED for b in CORRELATED)),
    "eda_shipping": query(f"""
      SELECT ship_mode, HALF_UP({mean('shipping_days')}, 4) AS avg_shipping_days, MIN(shipping_days) AS min_shipping_days,
        MAX(shipping_days) AS max_shipping_days, {total('sales')} AS total_sales, {total('profit')} AS total_profit,
        {ORDERS} AS order_count, {MARGIN}
      FROM sales GROUP BY ship_mode"""),
    "iqr_outliers": query(" UNION ALL ".join(outliers(c) for c in OUTLIERS)),
    "state_extremes": query(
        f"""(SELECT state, {total('profit')} AS profit FROM sales GROUP BY state ORDER BY SUM(sales.profit), state LIMIT 5)
            UNION ALL
            (SELECT state, {total('profit')} AS profit FROM sales GROUP BY state ORDER BY SUM(sales.profit) DESC, state LIMIT 5)"""
    ),
    "chart_discount_margin": query(
        f"SELECT {double('discount')} AS discount, {SUMS}, {COUNT}, {MARGIN} FROM sales GROUP BY sales.discount"
    ),
    "chart_regions": query(f"SELECT region, {SUMS} FROM sales GROUP BY region"),
    "chart_top_products": top_names("product_name"),
    "chart_top_customers": top_names("customer_name"),
}
