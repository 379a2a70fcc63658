from __future__ import annotations

from catalogue.sql.base import pct as any_pct
from catalogue.sql.base import ORDERS, double, guarded_pct, mean, money, query, ratio, total, whole
from catalogue.sql.rfm import quartile_summary

SELECTION = """market = 'ASIA' AND order_status = 'Completed' AND quarter = 'Q2'
  AND order_date BETWEEN DATE '1996-02-10' AND DATE '2000-11-20'"""

PRODUCT = "product_id, product_name, category, sub_category"


def pct(a: str, b: str) -> str:
    return any_pct(a, b, way="HALF_EVEN")


def chosen(where: str) -> str:
    return f"chosen AS (SELECT * FROM sales WHERE {where})"


def zeroed(x: str) -> str:
    return f"COALESCE({x}, 0.0)"


SUMS = f"{zeroed(total('sales'))} AS revenue, {zeroed(total('profit'))} AS profit"
MARGIN = f"{guarded_pct('profit', 'revenue')} AS profit_margin"

KPI_BODY = f"""
  SELECT {zeroed(total('sales'))} AS total_revenue, {zeroed(total('profit'))} AS total_profit,
    {guarded_pct('SUM(profit)', 'SUM(sales)')} AS profit_margin, {ORDERS} AS total_orders,
    {whole('COALESCE(SUM(quantity), 0)')} AS units_sold, COUNT(DISTINCT customer_id) AS total_customers,
    {zeroed(f"HALF_EVEN({ratio('SUM(sales)', ORDERS)}, 2)")} AS avg_order_value,
    COUNT(DISTINCT order_id) FILTER (is_returned) AS total_returned_orders,
    {guarded_pct('COUNT(DISTINCT order_id) FILTER (is_returned)', ORDERS)} AS return_rate,
    {zeroed(money('SUM(sales) FILTER (is_returned)'))} AS returned_revenue,
    COUNT(DISTINCT order_id) FILTER (profit > 0) AS profitable_orders,
    COUNT(DISTINCT order_id) FILTER (profit <= 0) AS loss_orders,
    {zeroed(f"HALF_EVEN({mean('discount')} * 100, 2)")} AS avg_discount,
    {zeroed(f"HALF_EVEN({mean('shipping_cost')}, 2)")} AS avg_shipping_cost
  FROM chosen"""


def kpis(where: str = "TRUE") -> str:
    return query(KPI_BODY, chosen(where))


def trend(where: str = "TRUE") -> str:
    return query(
        """SELECT a.year_month AS period, a.year, a.month, a.month_name, a.quarter, a.revenue, a.orders, a.units,
             CASE WHEN b.revenue > 0 THEN HALF_EVEN((a.revenue - b.revenue) / b.revenue * 100, 2) END AS yoy_growth,
             SCALED(AVG(a.revenue) OVER (ORDER BY a.year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2)
               AS rolling_3m_revenue,
             SCALED(SUM(a.revenue) OVER (ORDER BY a.year_month ROWS UNBOUNDED PRECEDING), 2) AS running_total_revenue
           FROM months a LEFT JOIN months b ON b.year = a.year - 1 AND b.month = a.month""",
        chosen(where),
        f"""months AS (SELECT year_month, year, month, month_name, quarter, {total('sales')} AS revenue, {ORDERS} AS orders,
              {whole('SUM(quantity)')} AS units FROM chosen GROUP BY ALL)""",
    )


def products(where: str, order: str, limit: int) -> str:
    return query(
        f"""SELECT {PRODUCT}, revenue, profit, quantity, {MARGIN}, avg_discount FROM totals
            ORDER BY {order}, product_id LIMIT {limit}""",
        f"""totals AS (SELECT {PRODUCT}, SUM(sales) AS s, SUM(profit) AS p, {SUMS}, {whole('SUM(quantity)')} AS quantity,
              HALF_EVEN({mean('discount')} * 100, 2) AS avg_discount FROM sales WHERE {where} GROUP BY {PRODUCT})""",
    )


BANDS = """
  bands AS (
    SELECT * FROM (VALUES (1, 'No Discount (0%)', 0.0, 0.0), (2, 'Low (1% - 10%)', 0.001, 0.10),
      (3, 'Moderate (11% - 20%)', 0.101, 0.20), (4, 'High (21% - 30%)', 0.201, 0.30),
      (5, 'Aggressive (31% - 50%)', 0.301, 0.50), (6, 'Severe (> 50%)', 0.501, 1.00)) AS t(band, label, low, high)),
  banded AS (
    SELECT band, label, low, high, COUNT(DISTINCT order_id) AS orders, COALESCE(CAST(ROUND(SUM(sales), 2) AS DOUBLE), 0.0) AS revenue,
      COALESCE(CAST(ROUND(SUM(profit), 2) AS DOUBLE), 0.0) AS profit,
      COUNT(DISTINCT order_id) FILTER (profit < 0) AS losing
    FROM bands LEFT JOIN chosen ON discount >= low AND discount <= high GROUP BY band, label, low, high)"""


def impact(where: str = "TRUE") -> str:
    return query(
        f"""SELECT label AS discount_band, {double('low')} AS min_discount, {double('high')} AS max_discount,
              orders AS order_count, revenue, profit, {MARGIN}, losing AS loss_orders_count FROM banded""",
        chosen(where),
        BANDS,
    )


def insights(where: str, period: str) -> str:
    def comma(x: str) -> str:
        return f"FORMAT('{{:,.2f}}', {x})"

    def plain(x: str, digits: int = 1) -> str:
        return f"FORMAT('{{:.{digits}f}}', {x})"

    return query(
        f"""
        SELECT 1 AS place, 'Revenue & Profit Summary ({period})' AS title,
          CONCAT('Generated $', {comma('total_revenue')}, ' in gross sales with a net profit of $', {comma('total_profit')},
            ', delivering an overall commercial profit margin of ', {plain('profit_margin', 2)}, '%.') AS description,
          'sales' AS category,
          CASE WHEN profit_margin > 10 THEN 'positive' WHEN profit_margin > 0 THEN 'neutral' ELSE 'negative' END AS status
        FROM kpi
        UNION ALL
        SELECT 2, CONCAT('Category Leader: ', category),
          CONCAT(category, ' is the primary revenue driver, contributing $', {comma('revenue')}, ' (', {plain('share')},
            '% of total revenue) with a ', {plain('margin')}, '% profit margin.'), 'category', 'positive'
        FROM leader
        UNION ALL
        SELECT 3, CONCAT('Margin Drainage Alert: ', product_name),
          CONCAT('This product created the largest commercial loss at -$', {comma('ABS(profit)')}, ' on $', {comma('revenue')},
            ' sales with an average discount rate of ', {plain('avg_discount')}, '%.'), 'risk', 'negative'
        FROM worst
        UNION ALL
        SELECT 4, CONCAT('Top Geographical Market: ', country),
          CONCAT(country, ' (', region, ' region) produced $', {comma('revenue')}, ' across ', FORMAT('{{:,}}', orders),
            ' orders with a net margin of ', {plain('margin')}, '%.'), 'geography', 'info'
        FROM territory
        UNION ALL
        SELECT 5, CONCAT('Discounting Elasticity Warning (', label, ')'),
          CONCAT('Orders discounted at >30% resulted in a profit margin of ', {plain('margin')}, '% with ',
            FORMAT('{{:,}}', losing), ' unprofitable transactions.'), 'discount',
          CASE WHEN margin < 0 THEN 'negative' ELSE 'neutral' END
        FROM (SELECT *, {guarded_pct('profit', 'revenue')} AS margin FROM banded WHERE band = 5 AND orders > 0)""",
        chosen(where),
        f"kpi AS ({KPI_BODY})",
        f"""leader AS (
              SELECT category, revenue, {guarded_pct('profit', 'revenue')} AS margin,
                {guarded_pct('revenue', '(SELECT SUM(sales) FROM chosen)')} AS share
              FROM (SELECT category, {SUMS} FROM chosen GROUP BY category) ORDER BY revenue DESC, category LIMIT 1)""",
        f"""worst AS (
              SELECT product_name, {SUMS}, HALF_EVEN({mean('discount')} * 100, 2) AS avg_discount
              FROM chosen WHERE profit < 0 GROUP BY {PRODUCT} ORDER BY SUM(chosen.profit), product_id LIMIT 1)""",
        f"""territory AS (
              SELECT country, region, revenue, orders, {guarded_pct('profit', 'revenue')} AS margin
              FROM (SELECT country, market, region, SUM(sales) AS s, {SUMS}, {ORDERS} AS orders FROM chosen
                    GROUP BY country, market, region)
              ORDER BY s DESC, country, market, region LIMIT 1)""",
        BANDS,
    )


CUSTOMERS = """
  buyers AS (
    SELECT customer_id, customer_name, segment, country, COUNT(DISTINCT order_id) AS order_count, SUM(sales) AS spend,
      SUM(profit) AS p
    FROM sales GROUP BY customer_id, customer_name, segment, country),
  placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY spend DESC, customer_id, country) AS place, COUNT(*) OVER () AS n FROM buyers)"""

LEDGER = """order_id, CAST(order_date AS VARCHAR) AS order_date, CAST(ship_date AS VARCHAR) AS ship_date, customer_name,
  country, region, product_name, category, sub_category, quantity, unit_price, CAST(sales AS DOUBLE) AS sales,
  CAST(discount AS DOUBLE) AS discount, CAST(profit AS DOUBLE) AS profit, order_status, ship_mode"""

LEDGER_ORDER = [
    "order_id", "order_date", "ship_date", "customer_name", "country", "region", "product_name", "category",
    "sub_category", "quantity", "unit_price", "sales", "discount", "profit", "order_status", "ship_mode",
]

FOUND = """(LOWER(CAST(order_id AS VARCHAR)) LIKE '%blue b%' OR LOWER(customer_name) LIKE '%blue b%'
  OR LOWER(product_name) LIKE '%blue b%' OR LOWER(country) LIKE '%blue b%')"""


def ledger(where: str, first: str, rest_without: str, size: int, skip: int) -> str:
    rest = ", ".join(f"sales.{c}" for c in LEDGER_ORDER if c != rest_without)
    return query(f"SELECT {LEDGER} FROM sales WHERE {where} ORDER BY {first}, {rest} LIMIT {size} OFFSET {skip}")


def returned(keys: str) -> str:
    return query(f"""
      SELECT {keys}, {ORDERS} AS return_count, {total('sales')} AS returned_revenue
      FROM sales WHERE is_returned GROUP BY {keys} ORDER BY return_count DESC, {keys} LIMIT 5""")


OPTIONS = ["year", "country", "market", "region", "category", "sub_category", "segment", "ship_mode"]


def spenders(limit: int) -> str:
    return query(
        f"""SELECT customer_id, customer_name, segment, country, {money('spend')} AS total_spend, {money('p')} AS total_profit,
              order_count, HALF_EVEN({money('spend')} / order_count, 2) AS avg_order_value
            FROM placed WHERE place <= {limit}""",
        CUSTOMERS,
    )


SQL = {
    "kpi_summary": kpis(),
    "filter_context": kpis(SELECTION),
    "sales_trend": trend(),
    "filtered_sales_trend": trend(SELECTION),
    "profit_trend": query(f"""
      SELECT year_month AS period, year, month, month_name, profit, {guarded_pct('profit', 's')} AS profit_margin,
        profitable_orders, loss_making_orders
      FROM (SELECT year_month, year, month, month_name, {total('profit')} AS profit, SUM(sales) AS s,
              COUNT(DISTINCT order_id) FILTER (sales.profit > 0) AS profitable_orders,
              COUNT(DISTINCT order_id) FILTER (sales.profit <= 0) AS loss_making_orders
            FROM sales GROUP BY year_month, year, month, month_name)"""),
    "category_performance": query(f"""
      SELECT category, revenue, profit, {MARGIN}, orders, quantity, {pct('revenue', 'SUM(s) OVER ()')} AS share_of_total
      FROM (SELECT category, SUM(sales) AS s, {SUMS}, {ORDERS} AS orders, {whole('SUM(quantity)')} AS quantity
            FROM sales GROUP BY category)"""),
    "subcategory_performance": query(f"""
      SELECT sub_category, category, revenue, profit, {MARGIN}, orders, quantity,
        {pct('revenue', 'SUM(s) OVER (PARTITION BY category)')} AS share_of_category
      FROM (SELECT sub_category, category, SUM(sales) AS s, {SUMS}, {ORDERS} AS orders, {whole('SUM(quantity)')} AS quantity
            FROM sales GROUP BY sub_category, category)"""),
    "top_products": products("TRUE", "s DESC", 10),
    "top_products_by_profit": products("TRUE", "p DESC", 25),
    "top_products_by_quantity": products("TRUE", "quantity DESC", 25),
    "loss_making_products": products("sales.profit < 0", "p", 10),
    "customer_performance": query(
        f"""SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (order_count > 1) AS repeat_customers,
              COUNT(*) FILTER (order_count = 1) AS single_purchase_customers,
              {pct('COUNT(*) FILTER (order_count > 1)', 'COUNT(*)')} AS repeat_customer_rate,
              HALF_EVEN({ratio('SUM(spend)', 'COUNT(*)')}, 2) AS avg_revenue_per_customer,
              {pct('SUM(spend) FILTER (place <= GREATEST(1, FLOOR(n * 0.2)))', 'SUM(spend)')} AS customer_contribution_top20
            FROM placed""",
        CUSTOMERS,
    ),
    "top_customers": spenders(10),
    "top_customers_50": spenders(50),
    "customer_segments": query(f"""
      SELECT segment, customer_count, revenue, profit, {MARGIN}, orders_count,
        HALF_EVEN(revenue / customer_count, 2) AS avg_spend, {pct('revenue', 'SUM(s) OVER ()')} AS share_of_revenue
      FROM (SELECT segment, COUNT(DISTINCT customer_id) AS customer_count, SUM(sales) AS s, {SUMS}, {ORDERS} AS orders_count
            FROM sales GROUP BY segment)"""),
    "filtered_rfm_quartiles": quartile_summary(SELECTION),
    "geography": query(f"""
      SELECT country, market, region, revenue, profit, {MARGIN}, orders
      FROM (SELECT country, market, region, SUM(sales) AS s, {SUMS}, {ORDERS} AS orders FROM sales GROUP BY ALL)
      ORDER BY s DESC, country, market, region LIMIT 15"""),
    "shipping": query(f"""
      SELECT ship_mode, {ORDERS} AS order_count, {total('sales')} AS total_revenue, {total('profit')} AS total_profit,
        HALF_EVEN({mean('shipping_cost')}, 2) AS avg_shipping_cost, HALF_EVEN({mean('shipping_days')}, 1) AS avg_shipping_days
      FROM sales GROUP BY ship_mode"""),
    "discount_impact": impact(),
    "filtered_discount_impact": impact(SELECTION),
    "order_ledger_page": ledger("TRUE", "sales.order_date DESC", "order_date", 20, 0),
    "order_ledger_search": ledger(FOUND, "sales.sales", "sales", 50, 100),
    "order_ledger_deep_page": ledger("TRUE", "sales.order_date DESC", "order_date", 100, 50_000),
    "order_ledger_info": query(f"""
      SELECT COUNT(*) AS total_records, 3 AS page, 50 AS page_size,
        CAST(GREATEST(1, CEIL(COUNT(*) / 50)) AS INTEGER) AS total_pages
      FROM sales WHERE {FOUND}"""),
    "returns_summary": query(f"""
      SELECT COUNT(DISTINCT order_id) FILTER (is_returned) AS total_returns,
        {pct('COUNT(DISTINCT order_id) FILTER (is_returned)', ORDERS)} AS return_rate,
        {zeroed(money('SUM(sales) FILTER (is_returned)'))} AS returned_revenue
      FROM sales"""),
    "top_returned_products": returned("product_name, category"),
    "top_returned_customers": returned("customer_name, country"),
    "insights": insights("TRUE", "across all historical periods"),
    "filtered_insights": insights("year = 1998", "in 1998"),
    "filter_options": query(
        " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, CAST(sales.{c} AS VARCHAR) AS value FROM sales" for c in OPTIONS)
        + """ UNION ALL SELECT 'min_date', CAST(MIN(order_date) AS VARCHAR) FROM sales
          UNION ALL SELECT 'max_date', CAST(MAX(order_date) AS VARCHAR) FROM sales
          UNION ALL SELECT 'quarter', CONCAT('Q', i) FROM RANGE(1, 5) t(i)
          UNION ALL SELECT 'order_status', s FROM (VALUES ('Completed'), ('Returned')) t(s)
          UNION ALL SELECT 'month', MONTHNAME(MAKE_DATE(2000, i, 1)) FROM RANGE(1, 13) t(i)"""
    ),
    "dataset_export": query("""
      SELECT order_id AS "Order ID", CAST(order_date AS VARCHAR) AS "Order Date", CAST(ship_date AS VARCHAR) AS "Ship Date",
        ship_mode AS "Ship Mode", customer_id AS "Customer ID", customer_name AS "Customer Name", segment AS "Segment",
        country AS "Country", city AS "City", state AS "State", postal_code AS "Postal Code", region AS "Region",
        product_id AS "Product ID", category AS "Category", sub_category AS "Sub-Category", product_name AS "Product Name",
        CAST(sales AS DOUBLE) AS "Sales", quantity AS "Quantity", CAST(discount AS DOUBLE) AS "Discount",
        CAST(profit AS DOUBLE) AS "Profit", shipping_days AS "Shipping Days", profit_margin AS "Profit Margin"
      FROM sales"""),
}
