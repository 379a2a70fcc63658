import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import cleaning
from tests.helpers import rows_of

D = datetime.date


def raw(spark, rows, names="Order ID,Order Date,Ship Date,Sales,Quantity,Discount,Profit"):
    columns = names.split(",")
    return spark.createDataFrame(rows, ",".join(f"`{c}` string" for c in columns))


def cleaned(spark, rows, names="Order ID,Order Date,Ship Date,Sales,Quantity,Discount,Profit", **more):
    return {row["order_id"]: row for row in rows_of(cleaning.clean(raw(spark, rows, names), **more))}


def test_dirty_numbers(spark):
    day = "2011-01-03"
    found = cleaned(
        spark,
        [
            ("a", day, day, "$1,234.50", "3.9", "20", "(7.5)"),
            ("b", day, day, "1e5", "x", "0.2", "1e400"),
            ("c", day, day, "12", "-4", "-0.1", None),
            ("d", day, day, "12", None, "0.99", "-3"),
            ("e", day, day, "12", "5", "1.0", ""),
            ("dropped1", day, day, "abc", "1", "0", "0"),
            ("dropped2", day, day, "", "1", "0", "0"),
            ("dropped3", day, day, "-5", "1", "0", "0"),
            ("dropped4", day, day, None, "1", "0", "0"),
            ("dropped5", day, day, "0", "1", "0", "0"),
        ],
    )
    assert set(found) == set("abcde")
    values = {k: [float(v[c]) for c in ("sales", "quantity", "discount", "profit")] for k, v in found.items()}
    assert values["a"] == [1234.5, 3, 0.2, 7.5]
    assert values["b"] == [15, 1, 0.2, 1400]
    assert values["c"] == [12, 1, 0.0, 0]
    assert values["d"] == [12, 1, 0.95, -3]
    assert values["e"] == [12, 5, 0.95, 0]


def test_numbers_too_large_for_a_decimal_take_the_default(spark):
    found = cleaned(spark, [("a", "2011-01-03", None, "5", "1", "0", "9" * 40), ("b", "2011-01-03", None, "9" * 40, "1", "0", "1")])
    assert list(found) == ["a"] and found["a"]["profit"] == 0


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2011-01-03", D(2011, 1, 3)),
        ("2011-1-3", D(2011, 1, 3)),
        ("1/3/2011", D(2011, 1, 3)),
        ("13/1/2011", D(2011, 1, 13)),
        ("01-03-2011", D(2011, 1, 3)),
        ("31-12-2011", D(2011, 12, 31)),
        ("2011/12/31", D(2011, 12, 31)),
        ("20111231", D(2011, 12, 31)),
        ("1/3/11", D(2011, 1, 3)),
        ("1/3/95", D(1995, 1, 3)),
        ("31.12.2011", D(2011, 12, 31)),
        ("2011-01-03 14:30", D(2011, 1, 3)),
        ("2011-01-03T14:30:15", D(2011, 1, 3)),
        ("1/3/2011 14:30", D(2011, 1, 3)),
        ("Jan 3, 2011", D(2011, 1, 3)),
        ("January 3, 2011", D(2011, 1, 3)),
        ("3 Jan 2011", D(2011, 1, 3)),
        ("03-Jan-2011", D(2011, 1, 3)),
        (" 2011-01-03 ", D(2011, 1, 3)),
        ("2011-02-30", None),
        ("2011-13-01", None),
        ("13/13/2011", None),
        ("not a date", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cleaning.parse_when(df.t).cast("date")).first()[0] == day


def test_rows_without_date_are_dropped_and_ship_dates_repaired(spark):
    rows = [
        ("a", "2011-01-03", "2011-01-01", "5", "1", "0", "1"),
        ("b", "2011-01-03", None, "5", "1", "0", "1"),
        ("c", "2011-01-03", "bad", "5", "1", "0", "1"),
        ("d", "2011-01-03", "2011-01-07", "5", "1", "0", "1"),
        ("e", "2011-01-03 18:00", "2011-01-05 06:00", "5", "1", "0", "1"),
        ("f", None, "2011-01-07", "5", "1", "0", "1"),
        ("g", "2011-02-30", "2011-01-07", "5", "1", "0", "1"),
    ]
    found = cleaned(spark, rows)
    assert {k: (v["ship_date"], v["shipping_days"]) for k, v in found.items()} == {
        "a": (D(2011, 1, 6), 3),
        "b": (D(2011, 1, 6), 3),
        "c": (D(2011, 1, 6), 3),
        "d": (D(2011, 1, 7), 4),
        "e": (D(2011, 1, 5), 1),  # less than two full days
    }
    stats = cleaning.cleaning_statistics(raw(spark, rows)).first().asDict()
    assert stats == {"initial_rows": 7, "invalid_dates": 2, "non_positive_sales": 0, "final_valid_rows": 5}


def test_missing_order_date_column_is_an_error(spark):
    with pytest.raises(ValueError):
        cleaning.clean(raw(spark, [("1", "2")], "Order ID,Sales"))


def test_defaults_of_absent_columns(spark):
    names = "date,quantity"
    found = rows_of(cleaning.clean(raw(spark, [("2011-01-01", "2"), ("2011-01-02", "4")], names)).orderBy("order_date"))
    first = found[0]
    assert [row["order_id"] for row in found] == ["ORD-000001", "ORD-000002"]
    assert (first["customer_id"], first["customer_name"], first["product_id"]) == ("CUST-0001", "Customer-1", "PROD-0001")
    assert (first["segment"], first["country"], first["postal_code"]) == ("Consumer", "United States", "00000")
    assert (float(first["sales"]), float(first["profit"]), float(first["unit_price"])) == (100.0, 15.0, 50.0)
    assert (first["order_status"], first["ship_mode"], first["order_priority"]) == ("Completed", "Standard Class", "Medium")
    assert first["ship_date"] == D(2011, 1, 4) and float(first["shipping_cost"]) == 0


def test_running_defaults_start_again(spark):
    days = [(f"2011-01-{1 + i % 28:02d}", str(i)) for i in range(2003)]
    found = cleaning.clean(raw(spark, days, "date,quantity"))
    ids = {row["order_id"]: row for row in rows_of(found)}
    assert len(ids) == 2003 and ids["ORD-002001"]["customer_id"] == "CUST-0001"
    assert ids["ORD-001001"]["product_id"] == "PROD-0001" and ids["ORD-002000"]["customer_id"] == "CUST-2000"


def test_sales_from_price_and_profit_from_cost(spark):
    names = "order_id,order_date,qty,price,cost"
    found = cleaned(spark, [("a", "2011-01-01", "3", "2.5", "5"), ("b", "2011-01-01", "2", "10", "?")], names)
    assert (float(found["a"]["sales"]), float(found["a"]["profit"])) == (7.5, 2.5)
    assert float(found["b"]["profit"]) == 3.0


def test_null_tokens(spark):
    names = "order_id,order_date,sales,customer_id,segment"
    rows = [(f"{i}", "2011-01-01", "5", token, token) for i, token in enumerate(["nan", "None", "NaN", "null", "  ", None])]
    rows.append(("kept", "2011-01-01", "5", " C 9 ", " Corporate "))
    found = cleaned(spark, rows, names)
    assert {v["segment"] for k, v in found.items() if k != "kept"} == {"Standard"}
    assert {v["customer_id"] for k, v in found.items() if k != "kept"} == {"N/A"}
    assert (found["kept"]["customer_id"], found["kept"]["segment"]) == ("C 9", "Corporate")


def test_synonyms_follow_list_order_and_use_one_source():
    mapping = cleaning.column_mapping(["Total", "Amount", "Invoice No", "Order-Date", "Freight", "Unknown"])
    assert mapping == {"Invoice No": "order_id", "Order-Date": "order_date", "Amount": "sales", "Freight": "shipping_cost"}


def test_return_flag_by_ledger_counts_no_line_twice(spark):
    rows = [("a", "2011-01-01", None, "5", "1", "0", "1"), ("b", "2011-01-01", None, "5", "1", "0", "1")]
    ledger = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "order_id string")
    found = rows_of(cleaning.clean(raw(spark, rows), ledger))
    assert {r["order_id"]: (r["is_returned"], r["order_status"]) for r in found} == {
        "a": (True, "Returned"),
        "b": (False, "Completed"),
    }
    assert len(found) == 2


def test_return_flag_from_text(spark):
    names = "order_id,order_date,sales,is_returned"
    found = cleaned(spark, [("a", "2011-01-01", "1", "True"), ("b", "2011-01-01", "1", "False"), ("c", "2011-01-01", "1", None)], names)
    assert {k: v["is_returned"] for k, v in found.items()} == {"a": True, "b": False, "c": False}


def test_calendar_columns(spark):
    row = cleaned(spark, [("a", "2011-01-01", None, "5", "1", "0", "1")])["a"]
    assert (row["year"], row["quarter"], row["month"], row["month_name"]) == (2011, "Q1", 1, "January")
    assert (row["week"], row["day"], row["day_of_week"], row["year_month"]) == (52, 1, "Saturday", "2011-01")


def test_postal_codes(spark):
    df = spark.createDataFrame([("6824",), ("06824",), ("123456",), (None,)], "c string")
    assert [r[0] for r in df.select(cleaning.pad_postal_code(df.c)).collect()] == ["06824", "06824", "123456", None]


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "x"), ("b", None)], "x string, y string")
    assert cleaning.duplicate_profile(df).first().asDict() == {
        "total_rows": 4, "distinct_rows": 3, "exact_duplicates": 1, "missing_values": 3,
    }
    assert cleaning.drop_exact_duplicates(df).count() == 3


def test_rules_of_the_cleaned_table(spark):
    good = cleaning.clean(raw(spark, [("a", "2011-01-01", None, "5", "1", "0", "1")]))
    cleaning.require_sound(good)
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="quantity_below_one"):
        cleaning.require_sound(good.withColumn("quantity", F.lit(0)))


def test_dates_of_usual_shapes(spark):
    texts = [
        "1/5/11 10:00", "01/05/2011 3:04 PM", "5-Jan-11", "2011-Jan-05", "Jan 5, 2011 10:30", "Wed, 05 Jan 2011", "2011.01.05",
        "20110105 10:00", "January 5th 2011", "05Jan2011", "2011-01-05T10:00:00Z", "5 January 2011 12:05 am", "20110105",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    days = frame.select(cleaning.parse_when(F.col("text")).cast("date").cast("string")).collect()
    assert {r[0] for r in days} == {"2011-01-05"}
    wrong = spark.createDataFrame([("order 5 of 2011",), ("2011-13-45",), ("",), ("12:30",), (None,)], "text string")
    assert {r[0] for r in wrong.select(cleaning.parse_when(F.col("text"))).collect()} == {None}


def test_tiny_sales_stay_and_each_date_is_parsed_once(spark):
    rows = [("A", "2011-01-05", "0.00004", "c", "n", "p"), ("B", "2011-01-05", "0", "c", "n", "p")]
    names = ["order_id", "order_date", "sales", "customer_id", "customer_name", "product_id"]
    raw = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names))
    cleaned = cleaning.clean(raw)
    assert [r["order_id"] for r in cleaned.collect()] == ["A"]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "janfebmar" not in plan  # rows look their dates up, only distinct texts are parsed
