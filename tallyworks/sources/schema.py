"""Column names and types of the cleaned order-line table.

The lists in this module are fixed values: header synonyms, defaults and tokens are part of the
input format.
"""

from __future__ import annotations

# Canonical column -> accepted headers, in order of preference. Headers are compared after trimming,
# lower-casing and turning blanks and hyphens into underscores.
COLUMN_SYNONYMS = {
    "order_id": [
        "order_id", "orderid", "invoice_id", "invoice_no", "transaction_id", "id", "invoiceno",
    ],
    "order_date": [
        "order_date", "orderdate", "trade_date", "date", "timestamp", "datetime", "invoice_date", "invoicedate",
    ],
    "ship_date": ["ship_date", "shipdate", "shipping_date"],
    "ship_mode": ["ship_mode", "shipmode", "delivery_method"],
    "customer_id": ["customer_id", "customerid", "client_id", "user_id"],
    "customer_name": ["customer_name", "customername", "client_name", "user_name"],
    "segment": ["segment", "customer_segment"],
    "customer_type": ["customer_type", "customer"],
    "country": ["country", "nation"],
    "city": ["city", "town"],
    "state": ["state", "province"],
    "postal_code": ["postal_code", "postalcode", "zip", "zip_code"],
    "market": ["market", "trade_market", "continent"],
    "region": ["region", "zone", "territory", "branch"],
    "product_id": ["product_id", "productid", "item_id", "sku", "stock_code", "stockcode"],
    "category": ["category", "product_category", "dept", "sector", "product_line", "item_group"],
    "sub_category": ["sub_category", "subcategory"],
    "product_name": ["product_name", "productname", "item_name", "title", "description"],
    "sales": [
        "sales", "revenue", "sale_amount", "amount", "total_sales", "turnover", "total_revenue", "total",
    ],
    "quantity": ["quantity", "qty", "units", "volume"],
    "unit_price": ["unit_price", "unitprice", "price"],
    "discount": ["discount", "disc", "discount_rate"],
    "profit": [
        "profit", "net_profit", "margin_amount", "earnings", "income", "pnl", "gross_income",
    ],
    "shipping_cost": ["shipping_cost", "shippingcost", "freight"],
    "order_priority": ["order_priority", "orderpriority", "priority"],
}

# Text columns with one default value.
TEXT_DEFAULTS = {
    "segment": "Consumer",
    "city": "Unknown",
    "state": "Unknown",
    "country": "United States",
    "postal_code": "00000",
    "market": "Global",
    "region": "Domestic",
    "category": "General Merchandise",
    "sub_category": "Standard Items",
    "product_name": "Standard Product",
    "ship_mode": "Standard Class",
    "order_priority": "Medium",
}

# Text columns that get a running default: format and the number after which it starts again.
RUNNING_DEFAULTS = {
    "order_id": ("ORD-%06d", None),
    "customer_id": ("CUST-%04d", 2000),
    "customer_name": ("Customer-%d", 2000),
    "product_id": ("PROD-%04d", 1000),
}

# Cell texts that mean "missing" in an order file.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

NULL_TOKENS = ["nan", "None", "", "NaN", "null"]
NULL_TEXT = "Standard"  # for columns with one default value
NULL_ID = "N/A"  # for columns with a running default

MONEY = "decimal(18,4)"
RATE = "decimal(7,4)"

# What a load says when a column is absent and its values are made up.
ABSENT_WARNINGS = {"profit": "Profit column not found; calculated at standard 15% margin."}

CLEAN_COLUMNS = [
    "order_id", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name", "segment",
    "country", "city", "state", "postal_code", "market", "region",
    "product_id", "category", "sub_category", "product_name",
    "sales", "quantity", "discount", "profit", "unit_price", "shipping_cost",
    "order_priority", "order_status", "is_returned", "is_profitable", "is_discounted",
    "shipping_days", "profit_margin",
    "year", "quarter", "month", "month_name", "week", "day", "day_of_week", "year_month",
]

# Of the stored tables: a quarter smaller than Spark's default on order lines, and no slower.
COMPRESSION = "zstd"

# What a table of loads has besides, for rows that were left out.
REJECT_COLUMNS = ("reject_reason", "raw_row")

# Types of the star schema tables in CSV form, in column order.
STAR_SCHEMAS = {
    "fact": (
        "order_id string, order_date date, ship_date date, ship_mode string, customer_id string, postal_code string, "
        "product_id string, sales decimal(18,4), quantity bigint, discount decimal(7,4), profit decimal(18,4), "
        "shipping_days int, profit_margin double, ship_mode_id int, order_date_key int, ship_date_key int"
    ),
    "customer": (
        "customer_id string, customer_name string, segment string, recency int, frequency bigint, "
        "monetary decimal(28,4), r_score int, f_score int, m_score int, rfm_score string, rfm_segment string"
    ),
    "product": "product_id string, category string, sub_category string, product_name string",
    "geography": "postal_code string, city string, state string, region string, country string",
    "shipping": "ship_mode_id int, ship_mode string, sla_target_days int, delivery_tier string",
    "date": (
        "date date, date_key int, year int, quarter string, year_quarter string, month_number int, month string, "
        "month_short string, year_month string, week_number int, day int, day_of_week string, day_of_week_num int, "
        "is_weekend int"
    ),
}

AUDIT_SCHEMA = (
    "filename string, file_size_bytes bigint, total_rows bigint, valid_rows bigint, invalid_rows bigint, "
    "status string, error_summary string, uploaded_at timestamp"
)
