import datetime
import json
import os
import pathlib
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from catalogue.raw_lines import raw_order_lines
from tallyworks.operators import cleaning
from tallyworks.plans import rfm, service, star, star_suite
from tallyworks.sources import files, loads, sinks
from tallyworks.sources.flat import read_flat, read_rejected
from tallyworks.sources.views import register_views
from tallyworks.streaming import events, ingest
from tests.helpers import make_lines, rows_of

HEAD = "Order ID,Order Date,Ship Date,Customer Name,Product Name,Sales,Quantity,Discount,Profit\n"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(path, text, encoding="utf-8"):
    with open(path, "wb") as file:
        file.write(text.encode(encoding))
    return path


def test_encodings(spark, folder):
    text = HEAD + "a,2011-01-03,2011-01-04,Zoë,Café,1,1,0,1\n"
    utf8 = put(f"{folder}/u.csv", text)
    latin = put(f"{folder}/l.csv", text, "latin-1")
    assert files.detect_encoding(spark, utf8) == "utf-8"
    assert files.detect_encoding(spark, latin) == "ISO-8859-1"
    for path in (utf8, latin):
        assert files.read_orders_csv(spark, path).first()["Customer Name"] == "Zoë"
    dash = put(f"{folder}/w.csv", HEAD + "a,2011-01-03,2011-01-04,A – B €,C,1,1,0,1\n", "cp1252")
    assert files.read_orders_csv(spark, dash, encoding="windows-1252").first()["Customer Name"] == "A – B €"


def test_quotes_missing_cells_and_line_breaks(spark, folder):
    path = put(f"{folder}/q.csv", HEAD + 'a,2011-01-03,NA,"He said ""hi"", twice","two\nlines",1,N/A,,nan\n')
    row = files.read_orders_csv(spark, path, multiline=True).first()
    assert row["Customer Name"] == 'He said "hi", twice' and row["Product Name"] == "two\nlines"
    assert [row[c] for c in ("Ship Date", "Quantity", "Discount", "Profit")] == [None] * 4


def test_load_replace_append_and_audit(spark, folder):
    first = put(f"{folder}/one.csv", HEAD + "a,2011-01-03,,Ann,Pen,5,1,0,1\nb,bad,,Ann,Pen,5,1,0,1\nc,2012-01-03,,Ann,Pen,0,1,0,1\n")
    second = put(f"{folder}/two.csv", HEAD + "d,2012-05-03,,Ann,Pen,5,1,0,1\n")
    ledger = put(f"{folder}/returns.csv", "Returned,Order ID,Market\nYes,a,EU\nYes,a,EU\n")
    table, audit = f"{folder}/table", f"{folder}/audit"
    returned = files.read_returns_csv(spark, ledger)

    result = sinks.load_order_lines(files.read_orders_csv(spark, first), table, audit, "one.csv", 10, returned_orders=returned)
    assert (result["total_rows"], result["valid_rows"], result["invalid_rows"]) == (3, 1, 2)
    assert read_flat(spark, table).filter("is_returned").count() == 1
    sinks.load_order_lines(files.read_orders_csv(spark, second), table, audit, "two.csv", replace=False)
    assert sorted(r.order_id for r in read_flat(spark, table).collect()) == ["a", "d"]
    sinks.load_order_lines(files.read_orders_csv(spark, second), table, audit, "again.csv")
    assert [r.order_id for r in read_flat(spark, table).collect()] == ["d"]

    loads = rows_of(sinks.latest_loads(spark, audit))
    assert [r["filename"] for r in loads] == ["again.csv", "two.csv", "one.csv"]
    assert [r["invalid_rows"] for r in loads] == [0, 0, 2] and {r["status"] for r in loads} == {"SUCCESS"}
    assert len(rows_of(sinks.latest_loads(spark, audit, limit=2))) == 2


def test_year_filter_prunes_folders(spark, folder):
    lines = make_lines(spark, [{"order_id": str(y), "order_date": __import__("datetime").date(y, 1, 1)} for y in (2011, 2012)])
    sinks.write_flat(lines, f"{folder}/flat")
    read = read_flat(spark, f"{folder}/flat").filter(F.col("year") == 2012)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and read.count() == 1


def test_export_round_trip(spark, folder):
    lines = make_lines(spark, [{"order_id": "a", "product_name": 'Pen, "blue"'}, {"order_id": "b", "market": "US"}])
    from tallyworks.operators.filters import FilterContext

    sinks.write_csv(service.dataset_export(lines, FilterContext(market="EU")), f"{folder}/out")
    back = rows_of(files.read_orders_csv(spark, f"{folder}/out"))
    assert len(back) == 1 and back[0]["Product Name"] == 'Pen, "blue"' and back[0]["Order Date"] == "2011-01-03"
    assert list(back[0]) == list(service.EXPORT_HEADERS.values())


def test_reports_as_csv(spark, folder):
    lines = make_lines(spark, [{}])
    sinks.write_reports({"shipping": service.shipping(lines), "geography": service.geography(lines)}, folder)
    assert files.read_orders_csv(spark, f"{folder}/shipping").first()["ship_mode"] == "First Class"


def test_numbered_rows_and_sizes(spark, folder):
    path = put(f"{folder}/o.csv", "Order ID,Order Date,Sales\nb,2011-01-04,1\na,2011-01-03,1\nc,2011-01-05,1\n")
    sinks.load_order_lines(files.read_orders_csv(spark, path), f"{folder}/t", f"{folder}/a", "o", number_rows=True)
    assert sorted(r.row_id for r in read_flat(spark, f"{folder}/t").collect()) == [1, 2, 3]
    page = service.order_ledger_page(read_flat(spark, f"{folder}/t"), page_size=2)
    assert page.columns[0] == "row_id" and [r.order_id for r in page.collect()] == ["c", "b"]
    assert files.size_in_bytes(spark, path) == __import__("os").path.getsize(path)


def test_views(spark):
    lines = make_lines(spark, [{"order_id": "a"}, {"order_id": "b", "product_id": "P2", "category": "Tools"}])
    register_views(lines, star.build_star(lines))
    by_category = spark.sql(
        "SELECT category, SUM(sales) AS s FROM fact_sales JOIN dim_products USING (product_id) GROUP BY category"
    )
    assert {r.category: float(r.s) for r in by_category.collect()} == {"Office": 10, "Tools": 10}
    assert spark.table("sales_transactions").count() == 2


def test_star_tables_on_disk(spark, folder):
    lines = make_lines(spark, [{"order_id": str(i)} for i in range(3)])
    star.write_star(star.build_star(lines), folder)
    tables = star.read_star(spark, folder)
    assert tables.fact.count() == 3 and tables.shipping.count() == 4
    sinks.write_csv(tables.shipping, f"{folder}/dump")
    again = files.read_table_csv(spark, f"{folder}/dump", tables.shipping.schema)
    assert again.exceptAll(tables.shipping).count() == 0


def test_star_as_csv(spark, folder):
    rows = [{"order_id": str(i), "customer_id": f"C{i % 3}", "sales": i + 1, "profit": -i} for i in range(9)]
    lines = make_lines(spark, rows)
    tables = star.build_star(lines, rfm.rfm_quintiles(lines))
    sinks.write_star_csv(tables, folder)
    back = files.read_star_csv(spark, folder)
    for name in ("fact", "customer", "product", "geography", "shipping", "date"):
        ours, theirs = getattr(tables, name), getattr(back, name)
        assert ours.columns == theirs.columns
        assert {tuple(map(str, r)) for r in ours.collect()} == {tuple(map(str, r)) for r in theirs.collect()}
    assert rows_of(star_suite.star_kpis(back)) == rows_of(star_suite.star_kpis(tables))


def test_stream_loads_new_files_once(spark, folder):
    inbox, table, audit, marks = (f"{folder}/{n}" for n in ("inbox", "table", "audit", "marks"))
    __import__("os").mkdir(inbox)
    schema = ",".join(f"`{c}` string" for c in HEAD.strip().split(","))

    def run():
        ingest.start_ingest(ingest.stream_order_files(spark, inbox, schema), table, audit, marks).awaitTermination()
        return sorted(r.order_id for r in ingest.read_ingested(spark, table).collect())

    put(f"{inbox}/one.csv", HEAD + "a,2011-01-03,,Ann,Pen,5,1,0,1\nb,bad,,Ann,Pen,5,1,0,1\n")
    assert run() == ["a"]
    put(f"{inbox}/two.csv", HEAD + "c,1/4/2011,,Ann,Pen,$5,1,0,1\n")
    assert run() == ["a", "c"]
    assert run() == ["a", "c"]
    loads = rows_of(ingest.read_batch_audit(spark, audit).orderBy("batch"))
    assert [(r["total_rows"], r["valid_rows"]) for r in loads] == [(2, 1), (1, 1)]


def test_raw_file_from_tables_has_every_defect(spark):
    lines = make_lines(spark, [{"order_id": str(i), "product_id": str(i)} for i in range(300)])
    lines = lines.withColumns({c: F.col(c).cast("bigint") for c in ("order_id", "product_id")}).withColumn("raw_ship_date", F.col("ship_date"))
    raw = raw_order_lines(lines)
    assert raw.filter("`Order Date` = 'not a date'").count() > 0 and raw.filter("Revenue = 'abc'").count() > 0


def put_lines(folder, name, rows):
    return put(f"{folder}/{name}", HEAD + "".join(f"{o},{d},,Ann,Pen,{s},1,0,1\n" for o, d, s in rows))


def state(spark, table, audit):
    lines = read_flat(spark, table)
    held = sorted((r.order_id, float(r.sales)) for r in lines.collect())
    return held, [tuple(r) for r in sinks.latest_loads(spark, audit).collect()]


def test_a_load_counts_once(spark, folder, monkeypatch):
    table, audit = f"{folder}/table", f"{folder}/audit"
    first = files.read_orders_csv(spark, put_lines(folder, "one.csv", [("a", "2011-01-03", 5), ("b", "bad", 5)]))
    second = files.read_orders_csv(spark, put_lines(folder, "two.csv", [("c", "2012-01-03", 7)]))
    sinks.load_order_lines(first, table, audit, "one.csv")
    sinks.load_order_lines(second, table, audit, "two.csv", replace=False)
    before = state(spark, table, audit)
    assert before[0] == [("a", 5), ("c", 7)] and len(before[1]) == 2

    again = sinks.load_order_lines(second.repartition(3), table, audit, "two.csv", replace=False)  # the same rows in another order
    assert again["valid_rows"] == 1 and state(spark, table, audit) == before
    assert sinks.load_order_lines(second, table, audit, "copy.csv", replace=False)["status"] == "SUCCESS"  # another file
    assert state(spark, table, audit)[0] == [("a", 5), ("c", 7), ("c", 7)]

    third = files.read_orders_csv(spark, put_lines(folder, "three.csv", [("d", "2013-01-03", 9), ("e", "2013-01-03", "x")]))
    held = state(spark, table, audit)
    monkeypatch.setattr(loads, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))  # killed with all files written
    with pytest.raises(KeyboardInterrupt):
        sinks.load_order_lines(third, table, audit, "three.csv", replace=False)
    monkeypatch.undo()
    assert state(spark, table, audit) == held
    monkeypatch.setattr(sinks, "record_load", lambda *_, **__: (_ for _ in ()).throw(KeyboardInterrupt))  # between table and audit
    with pytest.raises(KeyboardInterrupt):
        sinks.load_order_lines(third, table, audit, "three.csv", replace=False)
    monkeypatch.undo()
    for _ in range(2):
        sinks.load_order_lines(third, table, audit, "three.csv", replace=False)
        lines, log = state(spark, table, audit)
        assert lines == [*held[0], ("d", 9)]
        assert [(r[0], r[2], r[3]) for r in log] == [("three.csv", 2, 1), ("copy.csv", 1, 1), ("two.csv", 1, 1), ("one.csv", 2, 1)]


def test_replacing_takes_the_old_loads_out_at_the_commit(spark, folder, monkeypatch):
    table, audit = f"{folder}/table", f"{folder}/audit"
    one = files.read_orders_csv(spark, put_lines(folder, "one.csv", [("a", "2011-01-03", 5)]))
    two = files.read_orders_csv(spark, put_lines(folder, "two.csv", [("b", "2012-01-03", 7)]))
    sinks.load_order_lines(one, table, audit, "one.csv")
    old = read_flat(spark, table)
    monkeypatch.setattr(sinks, "outcome_counts", lambda _: 1 / 0)  # fails after the files are written
    with pytest.raises(ZeroDivisionError):
        sinks.load_order_lines(two, table, audit, "two.csv")
    monkeypatch.undo()
    lines, log = state(spark, table, audit)
    assert lines == [("a", 5)] and [(r[0], r[5]) for r in log] == [("two.csv", "FAILED"), ("one.csv", "SUCCESS")]
    assert log[0][6].startswith("ZeroDivisionError")
    sinks.load_order_lines(two, table, audit, "two.csv")
    assert state(spark, table, audit)[0] == [("b", 7)] and [r.order_id for r in old.collect()] == ["a"]  # a reader keeps its loads
    sinks.load_order_lines(one, table, audit, "one.csv", replace=False)
    assert state(spark, table, audit)[0] == [("a", 5), ("b", 7)]
    sinks.load_order_lines(one, table, audit, "one.csv")
    assert state(spark, table, audit)[0] == [("a", 5)]
    assert len(loads.remove_stale(spark, table)) == 1 and state(spark, table, audit)[0] == [("a", 5)]


def test_rejected_rows_are_kept_apart_with_their_reason(spark, folder):
    table, audit = f"{folder}/table", f"{folder}/audit"
    rows = [("ok", "2011-01-03", 5), ("big", "2011-01-03", "9" * 20), ("tiny", "2011-01-03", "0.00001"), ("zero", "2011-01-03", 0),
            ("minus", "2011-01-03", -3), ("word", "2011-01-03", "abc"), ("none", "2011-01-03", ""), ("day", "2011-02-30", 5), ("both", "x", "y")]
    raw = files.read_orders_csv(spark, put_lines(folder, "o.csv", rows))
    for number in (False, True):
        result = sinks.load_order_lines(raw, table, audit, f"o-{number}.csv", number_rows=number)
        lines, left = read_flat(spark, table), read_rejected(spark, table)
        assert {r.order_id: float(r.sales) for r in lines.collect()} == {"ok": 5, "tiny": 0.0001}
        assert {json.loads(r.raw_row)["order_id"]: r.reject_reason for r in left.collect()} == {
            "big": "sales too large", "zero": "sales not positive", "minus": "sales not positive", "word": "unreadable sales",
            "none": "unreadable sales", "day": "unreadable order date", "both": "unreadable order date",
        }
        assert json.loads(left.where("raw_row like '%minus%'").first().raw_row)["sales"] == "-3"
        assert (result["total_rows"], result["valid_rows"], result["invalid_rows"]) == (9, 2, 7)
        assert lines.count() + left.count() == result["total_rows"] and sum(result["rejected"].values()) == 7
        stats = cleaning.cleaning_statistics(raw).first()
        assert (stats.initial_rows, stats.final_valid_rows, stats.invalid_dates, stats.non_positive_sales) == (9, 2, 2, 5)
        assert not any(cleaning.domain_violations(lines).first())
        assert cleaning.clean(raw).count() == 2
        if number:
            assert sorted(r.row_id for r in lines.collect()) == [1, 2]


def test_what_a_load_reports(spark, folder):
    path = put(f"{folder}/o.csv", "Invoice No,Date,Amount\na,2011-01-03,5\n")
    result = sinks.load_order_lines(files.read_orders_csv(spark, path), f"{folder}/t", f"{folder}/a", "o.csv", load_id="night run")
    assert result["column_mappings"] == {"Invoice No": "order_id", "Date": "order_date", "Amount": "sales"}
    assert result["columns_detected"] == ["Invoice No", "Date", "Amount"] and len(result["warnings"]) == 1
    assert "Profit column not found" in result["warnings"][0] and result["duration_seconds"] >= 0
    assert files.file_identity(spark, path) == files.file_identity(spark, path)


def test_tables_without_rows(spark, folder):
    table, audit = f"{folder}/table", f"{folder}/audit"
    raw = files.read_orders_csv(spark, put_lines(folder, "bad.csv", [("a", "never", 5)]))
    result = sinks.load_order_lines(raw, table, audit, "bad.csv")
    assert (result["total_rows"], result["valid_rows"]) == (1, 0)
    assert read_flat(spark, table).count() == 0 and read_rejected(spark, table).count() == 1
    sinks.load_order_lines(raw.limit(0), table, audit, "none.csv")
    assert read_flat(spark, table).count() == 0 and read_rejected(spark, table).count() == 0
    assert set(read_flat(spark, table).columns) == {*cleaning.schema.CLEAN_COLUMNS, "row_id"}  # there are no customer ids
    with pytest.raises(ValueError):
        read_rejected(spark, folder)


def test_year_filter_prunes_folders_of_loads(spark, folder):
    raw = files.read_orders_csv(spark, put_lines(folder, "o.csv", [("a", "2011-01-03", 5), ("b", "2012-01-03", 5)]))
    sinks.load_order_lines(raw, f"{folder}/t", f"{folder}/a", "o.csv")
    read = read_flat(spark, f"{folder}/t").filter("year = 2012")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(outcome" in plan.replace("year#", "") and "(year" in plan.split("PartitionFilters")[1]
    assert read.count() == 1


def test_dates_of_repeating_and_of_distinct_texts(spark):
    """The dictionary of date texts and the parser of single rows agree."""
    texts = [f"2011-0{1 + i % 9}-1{i % 3}" for i in range(400)] + ["3 Jan 2011", None, "", "bad"] * 20
    frame = spark.createDataFrame([(t, str(i)) for i, t in enumerate(texts)], "order_date string, order_id string")
    assert cleaning._date_texts(frame, ["order_date"]) is not None
    looked_up = {r.order_id: r._ordered for r in cleaning.prepare_lines(frame).collect()}
    parsed = {r.order_id: r.t for r in frame.select("order_id", cleaning.parse_when(F.col("order_date")).alias("t")).collect()}
    assert looked_up == parsed and len(set(parsed.values())) > 9
    many = spark.range(400).select((F.lit("2011-01-01 10:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).cast("string").alias("order_date"))
    assert cleaning._date_texts(many, ["order_date"]) is None
    assert cleaning.prepare_lines(many).where("_ordered is null").count() == 0


def test_a_load_is_written_where_its_rows_are(spark, folder):
    """Two tasks of rows leave two files a year, in one stage without a sort; nothing is moved for the layout."""
    rows = [(f"o{i}", f"201{i % 3}-01-03" if i % 10 else "bad", "5") for i in range(60)]
    raw = spark.createDataFrame(rows, "order_id string, order_date string, sales string")
    raw = raw.withColumns({name: F.col("order_id") for name in cleaning.schema.RUNNING_DEFAULTS}).coalesce(2)
    told = sinks.load_order_lines(raw, f"{folder}/t", f"{folder}/a", "o.csv", load_id="1")
    assert (told["total_rows"], told["valid_rows"], told["rejected"]) == (60, 54, {cleaning.NO_DATE: 6})
    kept, left = read_flat(spark, f"{folder}/t"), read_rejected(spark, f"{folder}/t")
    assert {r.order_id for r in kept.collect()} == {o for o, d, _ in rows if d != "bad"} and left.count() == 6
    written = [p for p in files_of(f"{folder}/t") if "outcome=kept" in p and not p.endswith(".crc")]
    assert len(written) == 6 and all(p.endswith(".zstd.parquet") for p in written)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_sessions_of_others_get_methods_that_are_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    other, raw = spark.newSession(), [("o", "2011-01-03", "5")]
    try:
        for given, want in ((None, "8000"), ("9000", "9000")):
            other.conf.unset(name) if given is None else other.conf.set(name, given)
            cleaning.clean(other.createDataFrame(raw, "order_id string, order_date string, sales string"))
            assert other.conf.get(name) == want
    finally:
        other.conf.set(name, "8000")


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("part-*")}


def test_a_ledger_that_comes_late_flags_once(spark, folder, monkeypatch):
    table, audit = f"{folder}/table", f"{folder}/audit"
    one = files.read_orders_csv(spark, put_lines(folder, "one.csv", [("a", "2011-01-03", 5), ("b", "2012-01-03", 6), ("c", "bad", 1)]))
    two = files.read_orders_csv(spark, put_lines(folder, "two.csv", [("a", "2011-02-03", 7), ("d", "2013-02-03", 8)]))
    sinks.load_order_lines(one, table, audit, "one.csv")
    sinks.load_order_lines(two, table, audit, "two.csv", replace=False)
    before = files_of(table)
    ledger = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "order_id string")
    for _ in range(2):
        told = sinks.apply_returns(spark, table, audit, ledger, "returns.csv")
        assert (told["flagged_lines"], told["years"]) == (2, [2011])
        lines = {(r.order_id, float(r.sales)): (r.is_returned, r.order_status) for r in read_flat(spark, table).collect()}
        assert lines == {("a", 5): (True, "Returned"), ("a", 7): (True, "Returned"), ("b", 6): (False, "Completed"), ("d", 8): (False, "Completed")}
        after = files_of(table)
        assert before.items() <= after.items() and all("year=2011" in p for p in after.keys() - before.keys())
        assert [r.filename for r in sinks.latest_loads(spark, audit).collect()] == ["returns.csv", "two.csv", "one.csv"]
    assert read_rejected(spark, table).count() == 1
    assert sinks.apply_returns(spark, table, audit, ledger.where("order_id = 'zz'"), "none.csv")["years"] == []
    assert read_flat(spark, table).count() == 4

    late = spark.createDataFrame([("b",)], "order_id string")
    other = files.read_orders_csv(spark, put_lines(folder, "three.csv", [("e", "2012-05-03", 9)]))
    commit, tried = loads.commit, []

    def with_a_load_between(spark, path, load, after=None):
        if after is not None and not tried:
            tried.append(sinks.load_order_lines(other, table, audit, "three.csv", replace=False))
        return commit(spark, path, load, after)

    monkeypatch.setattr(loads, "commit", with_a_load_between)
    sinks.apply_returns(spark, table, audit, late, "late.csv")
    assert {r.order_id: r.is_returned for r in read_flat(spark, table).collect()} == {"a": True, "b": True, "d": False, "e": False}


def test_rows_that_are_sent_twice_are_stored_once(spark, folder):
    inbox, table, audit, marks = (f"{folder}/{n}" for n in ("inbox", "table", "audit", "marks"))
    pathlib.Path(inbox).mkdir()
    schema = ",".join(f"`{c}` string" for c in HEAD.strip().split(","))

    def run():
        arriving = ingest.stream_order_files(spark, inbox, schema, once_within="7 days")
        ingest.start_ingest(arriving, table, audit, marks).awaitTermination()
        return sorted((r.order_id, float(r.sales)) for r in ingest.read_ingested(spark, table).collect())

    row = "a,2011-01-03,,Ann,Pen,5,1,0,1\n"
    put(f"{inbox}/one.csv", HEAD + row + row)
    assert run() == [("a", 5)]
    put(f"{inbox}/two.csv", HEAD + row + "a,2011-01-03,,Ann,Pen,6,1,0,1\nb,,,,,,,,\n")
    assert run() == [("a", 5), ("a", 6)]
    month = 30 * 86400
    newer = put(f"{inbox}/three.csv", HEAD + "c,2011-01-03,,Ann,Pen,5,1,0,1\n")
    os.utime(newer, (time.time() + month, time.time() + month))
    assert run() == [("a", 5), ("a", 6), ("c", 5)]
    newest = put(f"{inbox}/four.csv", HEAD + row)  # longer than the delay after the first
    os.utime(newest, (time.time() + month + 60, time.time() + month + 60))
    assert run() == [("a", 5), ("a", 5), ("a", 6), ("c", 5)]


def test_event_windows(spark, folder):
    """Late events are counted apart; a restart goes on; a batch that is tried again counts once."""
    place = [f"{folder}/{n}" for n in ("inbox", "table", "marks")]
    at = lambda h, m=0, d=1: datetime.datetime(2024, 1, d, h, m)

    def drop(rows):
        frame = spark.createDataFrame([(i, t, 1, k, v) for i, (t, k, v) in enumerate(rows)], events.EVENTS)
        frame.coalesce(1).write.mode("append").parquet(place[0])
        for query in events.start_event_windows(events.stream_events(spark, place[0]), place[1], place[2]):
            query.awaitTermination()
        return state()

    def state():
        rows = events.read_event_windows(spark, place[1]).collect()
        return {(r.window_start.hour, r.event_type): (r.events, None if r.total is None else float(r.total), r.late) for r in rows}

    first = drop([(at(1, 5), "a", 1.5), (at(1, 55), "a", 2.25), (at(1, 0), None, None), (None, "a", 9.0), (at(4), "b", 1.0)])
    assert first == {(1, "a"): (2, 3.75, 0), (1, None): (1, None, 0), (4, "b"): (1, 1.0, 0)}
    # The newest event was at 4:00, so windows that ended by 2:00 are closed.
    second = drop([(at(1, 30), "a", 5.0), (at(1, 40), "c", 5.0), (at(2, 30), "a", 1.0), (at(4, 59), "b", 1.0)])
    assert second == first | {(1, "a"): (2, 3.75, 1), (1, "c"): (0, None, 1), (2, "a"): (1, 1.0, 0), (4, "b"): (2, 2.0, 0)}
    for kind in ("windows", "arrivals"):  # as if the last batch had died before it was noted
        last = max(pathlib.Path(place[2], kind, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    assert drop([]) == second


def test_event_windows_of_nothing(spark, folder):
    spark.createDataFrame([], events.EVENTS).write.parquet(f"{folder}/inbox")
    for query in events.start_event_windows(events.stream_events(spark, f"{folder}/inbox"), f"{folder}/t", f"{folder}/m"):
        query.awaitTermination()
    assert events.read_event_windows(spark, f"{folder}/t").count() == 0


@pytest.fixture
def no_broadcasts(spark):
    """As where nothing is small enough for Spark to broadcast it by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def written_plans(monkeypatch):
    """Plans of the frames that loads write."""
    plans, write = [], sinks._write_by_year

    def noted(rows, path):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, path)

    monkeypatch.setattr(sinks, "_write_by_year", noted)
    return plans


ODD_IDS = [*"abcdefghij", "", "é", "a b"]


def odd_orders(spark):
    rows = [(i, f"2011-01-{n + 1:02d}", "5") for n, i in enumerate([*ODD_IDS, None, "a", "zz"])]
    return spark.createDataFrame(rows, "`Order ID` string, `Order Date` string, Sales string")


def odd_ledger(spark):
    return spark.createDataFrame([(i,) for i in [*ODD_IDS[::2], None, "a", "not sold"]], "order_id string")


@pytest.mark.parametrize("most", [cleaning.LEDGER_BYTES, 0])
def test_a_load_moves_no_lines_for_its_ledger(spark, folder, monkeypatch, no_broadcasts, most):
    """Up to a size the ledger goes to the lines; beyond it the flags are the same."""
    monkeypatch.setattr(cleaning, "LEDGER_BYTES", most)
    plans, table = written_plans(monkeypatch), f"{folder}/table"
    sinks.load_order_lines(odd_orders(spark), table, f"{folder}/audit", "x.csv", returned_orders=odd_ledger(spark), load_id="1")
    flags = {(r.order_id, r.is_returned, r.order_status) for r in read_flat(spark, table).collect()}
    returned = {i or "Standard" for i in ODD_IDS[::2]} & {r[0] for r in flags}
    assert {r[0] for r in flags if r[1]} == returned - {"Standard", "N/A"}
    assert all((status == "Returned") == flag for _, flag, status in flags) and read_flat(spark, table).count() == 16
    assert ("SortMergeJoin" in plans[0]) == (most == 0)


@pytest.mark.parametrize("most", [cleaning.LEDGER_BYTES, 0])
def test_a_late_ledger_moves_no_lines(spark, folder, monkeypatch, no_broadcasts, most):
    monkeypatch.setattr(cleaning, "LEDGER_BYTES", most)
    plans, table = written_plans(monkeypatch), f"{folder}/table"
    sinks.load_order_lines(odd_orders(spark), table, f"{folder}/audit", "x.csv", load_id="1")
    told = sinks.apply_returns(spark, table, f"{folder}/audit", odd_ledger(spark), "returns.csv")
    found = [r.order_id for r in read_flat(spark, table).where("is_returned").collect()]
    assert sorted(found) == sorted(["a", "a", *"cegi", "a b"]) and told["flagged_lines"] == len(found)
    assert ("SortMergeJoin" in plans[1]) == (most == 0)
