from __future__ import annotations

from catalogue.sql.base import double, mean, money, pct, query, ratio, total


def level(value: str, edges: str) -> str:
    return "1 + " + " + ".join(f"CAST({double(value)} > {edges}[{i}] AS INTEGER)" for i in (1, 2, 3, 4))



QUINTILES = f"""
  buyers AS (
    SELECT customer_id, customer_name, segment,
      CAST((SELECT MAX(order_date) FROM sales) - MAX(order_date) AS INTEGER) AS recency,
      COUNT(DISTINCT order_id) AS frequency, SUM(sales) AS monetary, SUM(profit) AS total_profit,
      CAST(SUM(quantity) AS BIGINT) AS total_quantity, MIN(order_date) AS first_order_date,
      MAX(order_date) AS last_order_date
    FROM sales GROUP BY customer_id, customer_name, segment),
  edges AS (
    SELECT QUANTILE_CONT({double('recency')}, [0.2, 0.4, 0.6, 0.8]) AS re,
      QUANTILE_CONT({double('monetary')}, [0.2, 0.4, 0.6, 0.8]) AS me FROM buyers),
  scored AS (
    SELECT b.*, 6 - ({level('recency', 're')}) AS r_score,
      CAST(GREATEST(1, CEIL((f_place - 1) * 5 / (n - 1))) AS INTEGER) AS f_score, {level('monetary', 'me')} AS m_score
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS f_place, COUNT(*) OVER () AS n FROM buyers) b,
      edges),
  quintiles AS (
    SELECT *, CONCAT(r_score, f_score, m_score) AS rfm_score, r_score + f_score + m_score AS rfm_combined_score,
      CASE
        WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
        WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers'
        WHEN r_score >= 4 AND f_score <= 2 AND m_score >= 2 THEN 'Potential Loyalists'
        WHEN r_score >= 4 AND f_score = 1 AND m_score = 1 THEN 'New Customers'
        WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
        WHEN r_score >= 3 AND f_score <= 2 AND m_score <= 2 THEN 'Need Attention'
        WHEN r_score <= 2 AND f_score <= 2 AND m_score >= 3 THEN 'About to Sleep'
        WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Lost Customers'
        ELSE 'Hibernating' END AS rfm_segment,
      CASE
        WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
        WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers'
        WHEN r_score >= 4 AND f_score <= 3 THEN 'Potential Loyalists'
        WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
        WHEN r_score <= 2 AND f_score <= 2 AND m_score >= 3 THEN 'About to Sleep'
        WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating / Lost'
        ELSE 'Promising / Needs Attention' END AS seven
    FROM scored)"""

HIGHLIGHT = f"""customer_id, customer_name, {money('monetary')} AS total_sales, {money('total_profit')} AS total_profit,
  frequency, rfm_segment"""


def best(name: str, metric: str) -> str:
    return f"""(SELECT '{name}' AS highlight, {HIGHLIGHT} FROM quintiles
      ORDER BY quintiles.{metric} DESC, customer_id LIMIT 10)"""


QUARTILES = """
  buyers AS (
    SELECT customer_id, MAX(order_date) AS last_order, COUNT(DISTINCT order_id) AS frequency, SUM(sales) AS monetary,
      SUM(profit) AS profit FROM chosen GROUP BY customer_id),
  placed AS (
    SELECT *, COUNT(*) OVER () AS n, CAST((SELECT MAX(order_date) FROM chosen) - last_order AS INTEGER) AS recency,
      ROW_NUMBER() OVER (ORDER BY last_order DESC, customer_id) AS rp,
      ROW_NUMBER() OVER (ORDER BY frequency, customer_id) AS fp, ROW_NUMBER() OVER (ORDER BY monetary, customer_id) AS mp
    FROM buyers),
  levels AS (
    SELECT *, CAST(5 - GREATEST(1, CEIL((rp - 1) * 4 / (n - 1))) AS INTEGER) AS r_score,
      CAST(GREATEST(1, CEIL((fp - 1) * 4 / (n - 1))) AS INTEGER) AS f_score,
      CAST(GREATEST(1, CEIL((mp - 1) * 4 / (n - 1))) AS INTEGER) AS m_score
    FROM placed WHERE n >= 4),
  quartiles AS (
    SELECT *, CASE WHEN r_score >= 3 AND f_score >= 3 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 2 THEN 'Loyal Customers'
        WHEN r_score >= 3 THEN 'Potential Loyalists' WHEN r_score = 2 AND f_score >= 2 THEN 'At Risk'
        WHEN r_score = 1 AND f_score >= 3 THEN 'Cannot Lose Them' ELSE 'Hibernating' END AS segment
    FROM levels)"""


def quartile_summary(where: str) -> str:
    return query(
        f"""SELECT segment, COUNT(*) AS customer_count, {total('monetary')} AS total_revenue, {total('profit')} AS total_profit,
              HALF_EVEN({mean('recency')}, 1) AS avg_recency_days, HALF_EVEN({mean('frequency')}, 1) AS avg_frequency,
              HALF_EVEN({mean('monetary')}, 2) AS avg_monetary, {pct('COUNT(*)', 'MAX(n)', 2, 'HALF_EVEN')} AS share_of_customers
            FROM quartiles GROUP BY segment""",
        f"chosen AS (SELECT * FROM sales WHERE {where})",
        QUARTILES,
    )


SQL = {
    "rfm_quartile_scores": query(
        f"""SELECT customer_id, recency, frequency, {double('monetary')} AS monetary, {double('profit')} AS profit,
              r_score, f_score, m_score, r_score * 100 + f_score * 10 + m_score AS rfm_score, segment
            FROM quartiles""",
        "chosen AS (SELECT * FROM sales)",
        QUARTILES,
    ),
    "rfm_quartiles": quartile_summary("TRUE"),
    "rfm_quintiles": query(
        f"""SELECT customer_id, customer_name, segment, recency, frequency, {double('monetary')} AS monetary,
              {double('total_profit')} AS total_profit, total_quantity, CAST(first_order_date AS VARCHAR) AS first_order_date,
              CAST(last_order_date AS VARCHAR) AS last_order_date, SCALED({ratio('monetary', 'frequency')}, 2) AS aov,
              SCALED({ratio('total_profit', 'monetary')} * 100, 2) AS profit_margin_pct, r_score, f_score, m_score, rfm_score,
              rfm_combined_score
            FROM quintiles""",
        QUINTILES,
    ),
    "rfm_segments_9": query("SELECT customer_id, rfm_score, rfm_segment FROM quintiles", QUINTILES),
    "rfm_segments_7": query(
        f"""SELECT customer_id, recency + 1 AS recency_days, frequency AS frequency_orders, {money('monetary')} AS monetary_value,
              {money('total_profit', 4)} AS total_profit, customer_name, segment, r_score, f_score, m_score,
              seven AS customer_segment
            FROM quintiles""",
        QUINTILES,
    ),
    "rfm_segment_summary": query(
        f"""SELECT rfm_segment, COUNT(*) AS customer_count, {total('monetary')} AS total_sales,
              {total('total_profit')} AS total_profit, HALF_UP({mean('monetary')}, 2) AS avg_sales,
              HALF_UP({mean('total_profit')}, 2) AS avg_profit, HALF_UP({mean('frequency')}, 4) AS avg_frequency,
              HALF_UP({mean('recency')}, 4) AS avg_recency,
              {pct('COUNT(*)', '(SELECT COUNT(*) FROM quintiles)')} AS pct_customers,
              {pct('SUM(monetary)', '(SELECT SUM(sales) FROM sales)')} AS pct_sales,
              {pct('SUM(total_profit)', '(SELECT SUM(profit) FROM sales)')} AS pct_profit,
              {pct('SUM(total_profit)', 'SUM(monetary)')} AS profit_margin_pct
            FROM quintiles GROUP BY rfm_segment""",
        QUINTILES,
    ),
    "customer_highlights": query(
        " UNION ALL ".join(
            [
                best("top_by_sales", "monetary"),
                best("top_by_profit", "total_profit"),
                best("top_by_frequency", "frequency"),
                f"""(SELECT 'high_sales_at_loss', {HIGHLIGHT} FROM quintiles
                     WHERE quintiles.monetary > 5000 AND quintiles.total_profit < 0)""",
                f"(SELECT 'at_risk', {HIGHLIGHT} FROM quintiles WHERE quintiles.rfm_segment = 'At Risk')",
            ]
        ),
        QUINTILES,
    ),
    "rfm_reconcile": query(
        f"""SELECT COUNT(*) = (SELECT COUNT(DISTINCT customer_id) FROM sales) AS customer_count_ok,
              ABS(SUM(monetary) - (SELECT SUM(sales) FROM sales)) < 0.01 AS sales_ok,
              ABS(SUM(total_profit) - (SELECT SUM(profit) FROM sales)) < 0.01 AS profit_ok,
              COUNT(*) - COUNT(DISTINCT customer_id) AS duplicate_customers,
              COUNT(*) FILTER (r_score IS NULL) AS missing_scores,
              COUNT(*) FILTER (rfm_segment IS NULL) AS missing_segments
            FROM quintiles""",
        QUINTILES,
    ),
}
