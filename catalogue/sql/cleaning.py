"""What the cleaned table must hold, worked out from the values behind the raw text."""

from __future__ import annotations

from catalogue.sql.base import double, guarded_pct, money, query, total, whole

# The defects are those of the raw file; ``kept`` are the rows that survive cleaning.
KEPT = """
repaired AS (
  SELECT *,
    CASE WHEN product_id % 101 = 0 OR product_id % 103 = 0 THEN NULL ELSE order_date END AS od,
    CASE WHEN product_id % 7 = 0 OR raw_ship_date < order_date THEN order_date + 3 ELSE raw_ship_date END AS sd,
    CASE WHEN product_id % 89 = 0 THEN 0 WHEN product_id % 83 = 0 THEN -sales
      WHEN product_id % 79 = 0 THEN 1.53 ELSE sales END AS amount,
    CASE WHEN product_id % 17 = 0 OR product_id % 19 = 0 THEN 1 ELSE GREATEST(quantity, 1) END AS q,
    CASE WHEN product_id % 29 = 0 THEN 0 WHEN product_id % 31 = 0 THEN 0.95
      WHEN order_id % 2 = 0 THEN CASE WHEN discount * 100 > 1 THEN LEAST(discount, 0.95)
        ELSE LEAST(discount * 100, 0.95) END
      ELSE LEAST(discount, 0.95) END AS dd,
    CASE WHEN product_id % 37 = 0 THEN ABS(profit) ELSE profit END AS pp,
    CASE WHEN product_id % 41 = 0 THEN 0 ELSE shipping_cost END AS sc
  FROM sales),
returned AS (SELECT DISTINCT order_id FROM sales WHERE is_returned),
kept AS (
  SELECT CONCAT('ORD-', order_id) AS order_id, od AS order_date, sd AS ship_date,
    CASE WHEN product_id % 11 = 0 THEN 'Standard' ELSE ship_mode END AS ship_mode,
    CASE WHEN order_id % 97 = 0 THEN 'N/A' ELSE CAST(customer_id AS VARCHAR) END AS customer_id, customer_name,
    CASE WHEN order_id % 13 = 0 THEN 'Standard' ELSE segment END AS segment,
    country, city, state, postal_code, market, region, CAST(product_id AS VARCHAR) AS product_id, category,
    CASE WHEN product_id % 53 = 0 THEN 'Standard' ELSE sub_category END AS sub_category, product_name,
    CAST(amount AS DECIMAL(18,4)) AS sales, CAST(q AS BIGINT) AS quantity, CAST(dd AS DECIMAL(7,4)) AS discount,
    CAST(pp AS DECIMAL(18,4)) AS profit,
    CASE WHEN product_id % 43 = 0 OR product_id % 47 = 0 THEN SCALED(CAST(amount AS DOUBLE) / q, 2) ELSE unit_price END AS unit_price,
    CAST(sc AS DECIMAL(18,4)) AS shipping_cost, 'Medium' AS order_priority,
    order_id IN (SELECT order_id FROM returned) AS is_returned
  FROM repaired WHERE od IS NOT NULL AND amount > 0),
clean AS (
  SELECT *, CASE WHEN is_returned THEN 'Returned' ELSE 'Completed' END AS order_status, profit > 0 AS is_profitable,
    discount > 0 AS is_discounted, CAST(ship_date - order_date AS INTEGER) AS shipping_days,
    SCALED(CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE), 4) AS profit_margin,
    CAST(YEAR(order_date) AS INTEGER) AS year, CONCAT('Q', QUARTER(order_date)) AS quarter,
    CAST(MONTH(order_date) AS INTEGER) AS month, MONTHNAME(order_date) AS month_name,
    CAST(WEEK(order_date) AS INTEGER) AS week, CAST(DAY(order_date) AS INTEGER) AS day,
    DAYNAME(order_date) AS day_of_week, STRFTIME(order_date, '%Y-%m') AS year_month
  FROM kept)"""


def report(table: str, *parts: str) -> str:
    orders, returned = "COUNT(DISTINCT order_id)", "COUNT(DISTINCT order_id) FILTER (is_returned)"

    def share(part: str) -> str:
        return f"HALF_EVEN({double(part)} / COUNT(*) * 100, 1)"

    ranges = ", ".join(
        f"{double(f'{f}(t.{c})')} AS {f.lower()}_{c}" for c in ("shipping_days", "sales", "discount", "profit") for f in ("MIN", "MAX")
    )
    return query(
        f"""
        SELECT COUNT(*) AS total_transactions, {orders} AS unique_orders, COUNT(DISTINCT customer_id) AS unique_customers,
          COUNT(DISTINCT product_id) AS unique_products, CAST(MIN(order_date) AS VARCHAR) AS first_order,
          CAST(MAX(order_date) AS VARCHAR) AS last_order,
          (SELECT STRING_AGG(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM {table})) AS years,
          COUNT(DISTINCT country) AS countries, COUNT(DISTINCT market) AS markets, COUNT(DISTINCT region) AS regions,
          COUNT(DISTINCT category) AS categories, COUNT(DISTINCT sub_category) AS sub_categories,
          {total('sales')} AS total_revenue, {total('profit')} AS total_profit,
          {guarded_pct('SUM(profit)', 'SUM(sales)')} AS profit_margin_pct, {whole('SUM(quantity)')} AS total_units,
          {returned} AS returned_orders, {guarded_pct(returned, orders)} AS return_rate_pct,
          COALESCE({money('SUM(sales) FILTER (is_returned)')}, 0.0) AS returned_revenue,
          COUNT(*) FILTER (is_profitable) AS profitable_lines, {share('COUNT(*) FILTER (is_profitable)')} AS profitable_pct,
          COUNT(*) FILTER (NOT is_profitable) AS unprofitable_lines,
          COUNT(*) FILTER (is_discounted) AS discounted_lines, {share('COUNT(*) FILTER (is_discounted)')} AS discounted_pct,
          COUNT(*) FILTER (profit < 0) AS loss_lines, {ranges}
        FROM {table} t""",
        *parts,
    )


SQL = {
    "clean_order_lines": query(
        f"""SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, CAST(ship_date AS VARCHAR) AS ship_date, ship_mode,
              customer_id, customer_name, segment, country, city, state, postal_code, market, region, product_id, category,
              sub_category, product_name, {double('sales')} AS sales, quantity, {double('discount')} AS discount,
              {double('profit')} AS profit, unit_price, {double('shipping_cost')} AS shipping_cost, order_priority,
              order_status, is_returned, is_profitable, is_discounted, shipping_days, profit_margin, year, quarter, month,
              month_name, week, day, day_of_week, year_month
            FROM clean""",
        KEPT,
    ),
    "clean_stats": query(
        """SELECT COUNT(*) AS initial_rows, COUNT(*) FILTER (od IS NULL) AS invalid_dates,
             COUNT(*) FILTER (od IS NOT NULL AND amount <= 0) AS non_positive_sales,
             COUNT(*) FILTER (od IS NOT NULL AND amount > 0) AS final_valid_rows
           FROM repaired""",
        KEPT,
    ),
    "domain_checks": query(
        """SELECT COUNT(*) FILTER (NOT sales > 0) AS non_positive_sales, COUNT(*) FILTER (NOT quantity >= 1) AS quantity_below_one,
             COUNT(*) FILTER (NOT discount BETWEEN 0 AND 1) AS discount_out_of_range,
             COUNT(*) FILTER (NOT shipping_days >= 0) AS negative_shipping_days
           FROM clean""",
        KEPT,
    ),
    "dq_report": report("sales"),
    "dq_report_cleaned": report("clean", KEPT),
    "duplicate_profile": query(
        """SELECT COUNT(*) AS total_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM cells)) AS distinct_rows,
             COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM cells)) AS exact_duplicates,
             CAST(SUM(CAST(ordered IS NULL AS INTEGER) + CAST(shipped IS NULL AS INTEGER) + CAST(price IS NULL AS INTEGER)) AS BIGINT)
               AS missing_values
           FROM cells""",
        """cells AS (
             SELECT order_id, product_id,
               CASE WHEN product_id % 101 = 0 THEN 'bad' WHEN product_id % 103 <> 0 THEN CAST(order_date AS VARCHAR) END AS ordered,
               CASE WHEN product_id % 7 <> 0 THEN raw_ship_date END AS shipped,
               CASE WHEN product_id % 17 = 0 THEN 'x' ELSE CAST(quantity AS VARCHAR) END AS units,
               CASE WHEN product_id % 43 = 0 THEN NULL WHEN product_id % 47 = 0 THEN -1 ELSE unit_price END AS price
             FROM sales)""",
    ),
    "duplicates_removed": query(
        f"SELECT DISTINCT order_id, category, ship_mode, {double('discount')} AS discount FROM sales"
    ),
    "returned_flag": query(
        f"""SELECT is_returned, order_status, COUNT(*) AS lines, {double('SUM(sales)')} AS sales
            FROM clean GROUP BY is_returned, order_status""",
        KEPT,
    ),
    "load_and_audit": query(
        f"""SELECT CONCAT('load-', i) AS filename, (SELECT COUNT(*) FROM repaired) AS total_rows,
              (SELECT COUNT(*) FROM clean) AS valid_rows,
              (SELECT COUNT(*) FROM repaired) - (SELECT COUNT(*) FROM clean) AS invalid_rows, 'SUCCESS' AS status,
              2 * (SELECT COUNT(*) FROM clean) AS stored_rows, {double('2 * (SELECT SUM(sales) FROM clean)')} AS stored_sales
            FROM RANGE(1, 3) t(i)""",
        KEPT,
    ),
    "load_twice": query(
        f"""SELECT 'orders' AS filename, (SELECT COUNT(*) FROM repaired) AS total_rows, COUNT(*) AS valid_rows,
              (SELECT COUNT(*) FROM repaired) - COUNT(*) AS invalid_rows, 'SUCCESS' AS status,
              COUNT(*) AS stored_rows, {double('SUM(sales)')} AS stored_sales
            FROM clean""",
        KEPT,
    ),
    "late_returns": query(
        f"""SELECT year, is_returned, order_status, COUNT(*) AS lines, {double('SUM(sales)')} AS sales
            FROM clean GROUP BY year, is_returned, order_status""",
        KEPT,
    ),
    "rejected_rows": query(
        """SELECT CASE WHEN od IS NULL THEN 'unreadable order date' WHEN product_id % 89 = 0 THEN 'unreadable sales'
               ELSE 'sales not positive' END AS reject_reason,
             CONCAT('ORD-', order_id) AS order_id, CAST(product_id AS VARCHAR) AS product_id,
             CASE WHEN product_id % 101 = 0 THEN 'not a date' WHEN product_id % 103 = 0 THEN NULL
               WHEN (order_id + product_id) % 4 = 0 THEN STRFTIME(order_date, '%Y-%m-%d')
               WHEN (order_id + product_id) % 4 = 1 THEN STRFTIME(order_date, '%-m/%-d/%Y')
               WHEN (order_id + product_id) % 4 = 2 THEN STRFTIME(order_date, '%m-%d-%Y')
               WHEN DAY(order_date) > 12 THEN STRFTIME(order_date, '%d/%m/%Y') ELSE STRFTIME(order_date, '%Y/%m/%d') END AS order_date,
             CASE WHEN product_id % 89 = 0 THEN 'abc' WHEN product_id % 83 = 0 THEN CONCAT('-', sales)
               WHEN product_id % 79 = 0 THEN '1.5e3' WHEN product_id % 5 = 0 THEN CONCAT('$', FORMAT('{:,.2f}', CAST(sales AS DOUBLE)))
               WHEN product_id % 5 = 1 THEN CONCAT(sales, ' USD') ELSE CAST(sales AS VARCHAR) END AS sales
           FROM repaired WHERE od IS NULL OR amount <= 0""",
        KEPT,
    ),
    "stream_ingest": query(
        f"""SELECT year, order_status, COUNT(*) AS lines, {double('SUM(sales)')} AS sales, {whole('SUM(quantity)')} AS quantity
            FROM clean GROUP BY year, order_status""",
        KEPT,
    ),
    "stream_event_windows": """
WITH timed AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM events WHERE ts IS NOT NULL),
seen AS (SELECT MAX(ts) - INTERVAL 2 HOUR AS watermark FROM timed WHERE event_id % 97 <> 0),
placed AS (
  SELECT DATE_TRUNC('hour', ts) AS hour, event_type, CAST(value AS DECIMAL(18,2)) AS value,
    event_id % 97 = 0 AND DATE_TRUNC('hour', ts) + INTERVAL 1 HOUR <= watermark AS late
  FROM timed, seen)
SELECT STRFTIME(hour, '%Y-%m-%d %H:%M') AS window_start, event_type, COUNT(*) FILTER (NOT late) AS n_events,
  CAST(COALESCE(SUM(value) FILTER (NOT late), 0) AS DOUBLE) AS total, COUNT(*) FILTER (late) AS n_late
FROM placed GROUP BY ALL""",
    "surrogate_row_ids": query(f"""
      SELECT CAST(order_date AS VARCHAR) AS order_date, order_id, product_id, quantity, {double('sales')} AS sales,
        ROW_NUMBER() OVER (ORDER BY sales.order_date, order_id, product_id, quantity, sales.sales) AS row_id
      FROM sales"""),
    "postal_codes_padded": query("""
      SELECT raw_code, COUNT(*) AS lines,
        CASE WHEN LENGTH(raw_code) < 5 THEN LPAD(raw_code, 5, '0') ELSE raw_code END AS postal_code
      FROM (SELECT CASE WHEN customer_id % 2 = 0 THEN CAST(CAST(postal_code AS INTEGER) AS VARCHAR)
              ELSE CONCAT(CAST(postal_code AS INTEGER), '12345') END AS raw_code FROM sales)
      GROUP BY raw_code"""),
}
