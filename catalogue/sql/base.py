"""The order-line view over the trade tables and short forms for common expressions."""

from __future__ import annotations

import re

LINES = """
joined AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS raw_ship_date, l_linenumber,
    c_custkey, c_name, c_mktsegment, n_nationkey, n_name, r_name, p_partkey, p_type, p_brand, p_name, p_size,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS sales, CAST(l_quantity AS INTEGER) AS quantity,
    CAST(ROUND(l_discount * 100) AS INTEGER) AS steps, CAST(l_tax AS DECIMAL(4,2)) AS tax,
    o_orderstatus, o_orderpriority
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
shaped AS (
  SELECT o_orderkey AS order_id, order_date, raw_ship_date,
    CASE o_orderkey % 4 WHEN 0 THEN 'Same Day' WHEN 1 THEN 'First Class' WHEN 2 THEN 'Second Class'
      ELSE 'Standard Class' END AS ship_mode,
    CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END + l_linenumber % 4 AS INTEGER)
      AS shipping_days,
    c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
    n_name AS country, r_name AS market,
    CONCAT(n_name, '/', CAST(c_custkey % 20 AS INTEGER)) AS city,
    CONCAT(n_name, '/', CAST(c_custkey % 4 AS INTEGER)) AS state,
    LPAD(CAST(n_nationkey * 20 + c_custkey % 20 AS VARCHAR), 5, '0') AS postal_code,
    CONCAT(r_name, '-', CAST(n_nationkey % 3 AS INTEGER)) AS region,
    p_partkey AS product_id, p_type AS category, CONCAT(p_type, '/', p_brand) AS sub_category, p_name AS product_name,
    sales, quantity,
    CAST(CAST(steps * steps * 8 AS DECIMAL(6,0)) * CAST('0.001' AS DECIMAL(4,3)) AS DECIMAL(7,3)) AS discount,
    CAST(sales * CAST(290 + (p_size - 25) * 4 - steps * steps * 8 AS DECIMAL(5,0)) * CAST('0.001' AS DECIMAL(4,3))
      AS DECIMAL(14,4)) AS profit,
    CAST(sales * tax AS DECIMAL(14,4)) AS shipping_cost,
    o_orderpriority AS order_priority,
    (o_orderstatus = 'P' AND o_orderkey % 5 = 0) AS is_returned
  FROM joined
),
sales AS (
  SELECT *, (order_date + shipping_days) AS ship_date,
    SCALED(CAST(sales AS DOUBLE) / quantity, 2) AS unit_price,
    CASE WHEN is_returned THEN 'Returned' ELSE 'Completed' END AS order_status,
    profit > 0 AS is_profitable, discount > 0 AS is_discounted,
    SCALED(CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE), 4) AS profit_margin,
    CAST(YEAR(order_date) AS INTEGER) AS year, CONCAT('Q', QUARTER(order_date)) AS quarter,
    CAST(MONTH(order_date) AS INTEGER) AS month, MONTHNAME(order_date) AS month_name,
    CAST(WEEK(order_date) AS INTEGER) AS week, CAST(DAY(order_date) AS INTEGER) AS day,
    DAYNAME(order_date) AS day_of_week, STRFTIME(order_date, '%Y-%m') AS year_month
  FROM shaped
)"""


def _nearest(x: str, digits: str) -> str:
    pattern = "{:." + digits + "f}"
    return f"(CAST(FORMAT('{pattern}', {x}) AS DOUBLE) + 0.0)"


def _half_up(x: str, digits: str) -> str:
    part = 2 ** (int(digits) + 1)
    tie = f"({x}) * {part}.0 = ROUND(({x}) * {part}.0)"
    return f"(CASE WHEN {tie} THEN ROUND({x}, {digits}) + 0.0 ELSE {_nearest(x, digits)} END)"


def _scaled(x: str, digits: str) -> str:
    scale = 10 ** int(digits)
    return f"(ROUND_EVEN(({x}) * {scale}.0, 0) / {scale}.0 + 0.0)"


# Ways to round a double: HALF_EVEN and HALF_UP from its exact value, SCALED after scaling it.
ROUNDINGS = {"HALF_EVEN": _nearest, "HALF_UP": _half_up, "SCALED": _scaled}


def _spell_out(text: str) -> str:
    """Replace NAME(expression, digits) by the SQL for that way of rounding, innermost first."""
    while found := list(re.finditer(r"\b(HALF_EVEN|HALF_UP|SCALED)\(", text)):
        start = found[-1]
        depth, i = 1, start.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        expression, digits = text[start.end() : i - 1].rsplit(",", 1)
        text = text[: start.start()] + ROUNDINGS[start.group(1)](expression.strip(), digits.strip()) + text[i:]
    return text


def query(body: str, *parts: str) -> str:
    """The body over ``sales`` and further named parts."""
    text = "WITH " + ",\n".join([LINES.strip(), *[p.strip() for p in parts]]) + "\n" + body.strip()
    return _spell_out(text)


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def money(total: str, digits: int = 2) -> str:
    return f"CAST(ROUND({total}, {digits}) AS DOUBLE)"


def total(column: str) -> str:
    return money(f"SUM({column})")


def ratio(a: str, b: str) -> str:
    return f"({double(a)} / NULLIF({double(b)}, 0))"


def pct(a: str, b: str, digits: int = 2, way: str = "HALF_UP") -> str:
    return f"{way}({ratio(a, b)} * 100, {digits})"


def guarded_pct(a: str, b: str, digits: int = 2) -> str:
    return f"CASE WHEN {b} > 0 THEN {pct(a, b, digits, 'HALF_EVEN')} ELSE 0.0 END"


def mean(column: str) -> str:
    return f"({double(f'SUM({column})')} / NULLIF(COUNT({column}), 0))"


def whole(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


ORDERS = "COUNT(DISTINCT order_id)"
MARGIN = pct("SUM(profit)", "SUM(sales)") + " AS profit_margin_pct"
