import datetime
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tallyworks.operators.filters import FilterContext
from tallyworks.plans import eda, flat_suite, forecast, measures, rfm, service, star, star_suite
from tests.helpers import make_lines, rows_of

D = datetime.date


def months(start, count, value=lambda i: 100 + i):
    return [
        {"order_id": f"O{i}", "order_date": D(start + i // 12, i % 12 + 1, 5), "sales": value(i), "profit": value(i) / 4}
        for i in range(count)
    ]


def test_growth_with_a_missing_month_is_empty_not_shifted(spark):
    rows = [r for i, r in enumerate(months(2011, 24)) if i != 4]
    found = {r["period"]: r for r in rows_of(service.sales_trend(make_lines(spark, rows)))}
    assert found["2012-05"]["yoy_growth"] is None
    assert found["2012-06"]["yoy_growth"] == round((117 - 105) / 105 * 100, 2)
    assert found["2011-06"]["rolling_3m_revenue"] == round((102 + 103 + 105) / 3, 2)
    last = max(found)
    assert found[last]["running_total_revenue"] == sum(100 + i for i in range(24) if i != 4)


def test_no_growth_over_a_month_without_income(spark):
    rows = months(2011, 13, value=lambda i: 0 if i == 0 else 10)
    found = {r["period"]: r["yoy_growth"] for r in rows_of(service.sales_trend(make_lines(spark, rows)))}
    assert found["2012-01"] is None


def test_empty_selection(spark):
    lines = make_lines(spark, [{}])
    none = FilterContext(year=1900)
    kpi = rows_of(service.kpi_summary(lines, none))[0]
    assert set(kpi.values()) == {0}
    assert rows_of(service.sales_trend(lines, none)) == []
    assert rows_of(service.customer_performance(lines, none)) == [
        {
            "total_customers": 0, "repeat_customers": 0, "single_purchase_customers": 0, "repeat_customer_rate": 0.0,
            "avg_revenue_per_customer": 0.0, "customer_contribution_top20": 0.0,
        }
    ]
    assert [r["order_count"] for r in rows_of(service.discount_impact(lines, none))] == [0] * 6
    assert [r["title"] for r in rows_of(service.insights(lines, none))] == ["Revenue & Profit Summary (in 1900)"]
    assert rows_of(service.order_ledger_info(lines, none))[0]["total_pages"] == 1
    assert rows_of(service.rfm_quartiles(lines, none)) == []


def test_zero_denominators(spark):
    lines = make_lines(spark, [{"sales": 0, "profit": -1}])
    assert rows_of(flat_suite.sales_profit_by_year(lines))[0]["profit_margin_pct"] is None
    assert rows_of(service.category_performance(lines))[0]["profit_margin"] == 0.0
    assert rows_of(measures.line_measure(lines, "profit_margin", ["market"]))[0]["profit_margin"] == 0.0


def test_kpi_counts_an_order_as_both_profitable_and_losing(spark):
    lines = make_lines(spark, [{"profit": 5}, {"profit": -2}, {"order_id": "O2", "profit": 0, "is_returned": True}])
    kpi = rows_of(service.kpi_summary(lines))[0]
    assert (kpi["total_orders"], kpi["profitable_orders"], kpi["loss_orders"]) == (2, 1, 2)
    assert (kpi["total_returned_orders"], kpi["return_rate"], kpi["returned_revenue"]) == (1, 50.0, 10.0)


def test_discount_bands_keep_their_gaps(spark):
    discounts = ["0", "0.0005", "0.001", "0.10", "0.1005", "0.20", "0.50", "0.505", "0.95"]
    lines = make_lines(spark, [{"order_id": f"O{i}", "discount": d} for i, d in enumerate(discounts)])
    found = {r["discount_band"]: r["order_count"] for r in rows_of(service.discount_impact(lines))}
    assert list(found.values()) == [1, 2, 1, 0, 1, 2]
    bands = {r["discount_band"]: r["transaction_count"] for r in rows_of(flat_suite.discount_bands(lines))}
    assert sum(bands.values()) == len(discounts) and bands[">40%"] == 3


@pytest.mark.parametrize(("customers", "rows"), [(3, 0), (4, 4), (6, 6)])
def test_quartiles_need_four_customers(spark, customers, rows):
    lines = make_lines(
        spark,
        [{"customer_id": f"C{i}", "order_id": f"O{i}", "order_date": D(2011, 1, 1 + i), "sales": 10 + i} for i in range(customers)],
    )
    found = rows_of(service.rfm_quartile_scores(lines))
    assert len(found) == rows
    if customers == 6:
        assert Counter(r["m_score"] for r in found) == {1: 2, 2: 1, 3: 1, 4: 2}
        newest = max(found, key=lambda r: r["customer_id"])
        assert (newest["recency"], newest["r_score"]) == (0, 4)


def test_customer_in_two_countries_counts_twice(spark):
    lines = make_lines(
        spark, [{"order_id": "O1"}, {"order_id": "O2"}, {"order_id": "O3", "country": "Spain"}, {"customer_id": "C2", "order_id": "O4"}]
    )
    found = rows_of(service.customer_performance(lines))[0]
    assert (found["total_customers"], found["repeat_customers"], found["customer_contribution_top20"]) == (3, 1, 50.0)
    assert len(rows_of(service.top_customers(lines, limit=50))) == 3
    assert len(rows_of(service.top_customers(lines, limit=2))) == 2


def test_losing_products_sum_losing_lines_only(spark):
    lines = make_lines(spark, [{"profit": 100}, {"profit": -1, "sales": 7}])
    assert rows_of(service.loss_making_products(lines))[0]["revenue"] == 7.0


def test_search_takes_wildcards_as_text(spark):
    lines = make_lines(spark, [{"product_name": "100% Paper"}, {"product_name": "1000 Sheets"}])
    page = rows_of(service.order_ledger_page(lines, search="00% p"))
    assert [r["product_name"] for r in page] == ["100% Paper"]


def test_pages(spark):
    lines = make_lines(spark, [{"order_id": f"O{i:02d}", "sales": i + 1} for i in range(45)])
    third = rows_of(service.order_ledger_page(lines, page=3, page_size=20, sort_by="sales", sort_desc=False))
    assert [float(r["sales"]) for r in third] == [41, 42, 43, 44, 45]
    assert rows_of(service.order_ledger_info(lines, page=3))[0] == {
        "total_records": 45, "page": 3, "page_size": 20, "total_pages": 3,
    }


def test_pages_are_slices_of_the_whole_order(spark):
    lines = make_lines(spark, [{"order_id": f"O{i:02d}", "sales": i % 7} for i in range(90)])
    whole = rows_of(service.order_ledger_page(lines, page=1, page_size=1000, sort_by="sales"))
    assert [float(r["sales"]) for r in whole] == sorted((float(i % 7) for i in range(90)), reverse=True)
    for page in (1, 4, 5):
        got = rows_of(service.order_ledger_page(lines, page=page, page_size=20, sort_by="sales"))
        assert got == whole[(page - 1) * 20 : page * 20]
    assert rows_of(service.order_ledger_page(lines, page=6, page_size=20)) == []


def test_late_pages_equal_early_ones(spark, monkeypatch):
    lines = make_lines(spark, [{"order_id": f"O{i:02d}", "sales": i % 7, "ship_mode": None if i % 3 else "First Class"} for i in range(90)])
    pages = [dict(page=page, page_size=size, sort_by=by) for page, size, by in ((1, 20, "sales"), (2, 30, "profit"), (5, 20, "order_date"), (9, 20, "sales"))]
    early = [rows_of(service.order_ledger_page(lines, **page)) for page in pages]
    monkeypatch.setattr(service, "EARLY_ROWS", 0)
    assert [rows_of(service.order_ledger_page(lines, **page)) for page in pages] == early


def reference_forecast(y, horizon, positive):
    """The method on plain arrays."""
    n = len(y)
    t = np.arange(n)
    slope, intercept = np.polyfit(t, y, 1)
    period = 12 if n >= 18 else 4 if n >= 8 else 2
    off = np.array([np.mean((y - intercept - slope * t)[i::period]) for i in range(period)])
    fitted = intercept + slope * t + off[t % period]
    spread = np.std(y - fitted)
    ahead = np.arange(n, n + horizon)
    expected = intercept + slope * ahead + off[ahead % period]
    if positive:
        expected = np.maximum(0, expected)
    margin = 1.96 * spread * np.sqrt(1 + np.arange(horizon) * 0.15)
    return fitted, expected, expected - margin, expected + margin


@pytest.mark.parametrize("n", [6, 8, 17, 18, 40])
@pytest.mark.parametrize("metric", ["sales", "profit"])
def test_forecast(spark, n, metric):
    rng = random.Random(n)
    series = [rng.randrange(100, 4000) / 4 for _ in range(n)]
    lines = make_lines(spark, months(2011, n, value=lambda i: series[i]))
    found = rows_of(forecast.forecast(lines, metric, horizon=5))
    y = np.array(series) / (1 if metric == "sales" else 4)
    fitted, expected, low, high = reference_forecast(y, 5, metric == "sales")
    assert [r["actual"] for r in found[n:]] == [None] * 5
    assert [r["forecast"] for r in found[:n]] == pytest.approx(fitted, abs=0.0051)
    assert [r["forecast"] for r in found[n:]] == pytest.approx(expected, abs=0.0051)
    assert [r["upper_bound"] for r in found[n:]] == pytest.approx(high, abs=0.0051)
    if metric == "sales":
        low = np.maximum(0, low)
    assert [r["lower_bound"] for r in found[n:]] == pytest.approx(low, abs=0.0051)
    assert found[n]["period"] == f"{2011 + n // 12}-{n % 12 + 1:02d}"


def test_forecast_of_a_short_series_is_empty(spark):
    lines = make_lines(spark, months(2011, 5))
    assert rows_of(forecast.forecast(lines)) == []
    summary = rows_of(forecast.forecast_summary(lines))[0]
    assert (summary["model_name"], summary["historical_count"], summary["mae"]) == ("Moving Average Baseline", 5, 0.0)
    with pytest.raises(ValueError):
        forecast.forecast(lines, horizon=25)


def test_forecast_of_a_straight_line_keeps_a_band(spark):
    lines = make_lines(spark, months(2011, 24, value=lambda i: 100))
    last = rows_of(forecast.forecast(lines, horizon=1))[-1]
    assert last["forecast"] == 100.0 and last["upper_bound"] >= 100.0


def basket_lines(spark):
    rng = random.Random(1)
    rows = [{"order_id": f"O{rng.randrange(60)}", "sub_category": f"S{rng.randrange(9)}"} for _ in range(300)]
    rows += [{"order_id": "HOT", "sub_category": f"S{i % 9}"} for i in range(150)]  # a third of all lines
    return rows


def test_basket_pairs_equal_brute_force(spark):
    rows = [r | {"product_id": f"P-{r['sub_category']}"} for r in basket_lines(spark)]
    held = {}
    for row in rows:
        held.setdefault(row["order_id"], set()).add(row["sub_category"])
    pairs = Counter(p for basket in held.values() for p in itertools.combinations(sorted(basket), 2))
    expected = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    found = rows_of(star_suite.basket_pairs(star.build_star(make_lines(spark, rows))))
    assert [((r["subcat_a"], r["subcat_b"]), r["times_bought_together"]) for r in found] == expected


def test_star_schema(spark):
    lines = make_lines(
        spark,
        [
            {"order_date": D(2011, 12, 30), "ship_date": D(2012, 1, 2), "shipping_days": 3, "customer_name": "Ann"},
            {"order_id": "O2", "order_date": D(2011, 12, 31), "customer_name": "Anne", "ship_mode": "Drone"},
        ],
    )
    tables = star.build_star(lines)
    assert [r["customer_name"] for r in rows_of(tables.customer)] == ["Ann"]  # the first line wins
    days = rows_of(tables.date.orderBy("date"))
    assert [r["date_key"] for r in days] == [20111230, 20111231, 20120101, 20120102]
    assert [(r["week_number"], r["day_of_week_num"], r["is_weekend"]) for r in days] == [(52, 5, 0), (52, 6, 1), (52, 7, 1), (1, 1, 0)]
    assert days[0]["year_quarter"] == "2011-Q4" and days[0]["month_short"] == "Dec"
    fact = {r["order_id"]: r for r in rows_of(tables.fact)}
    assert (fact["O1"]["ship_mode_id"], fact["O1"]["ship_date_key"], fact["O2"]["ship_mode_id"]) == (2, 20120102, None)
    late = rows_of(measures.on_time_rate(tables, ["ship_mode"]))
    assert {r["ship_mode"]: r["on_time_rate"] for r in late} == {"First Class": 0.0, "Drone": 0.0}


def test_segments_and_reconciliation(spark):
    rng = random.Random(5)
    rows = [
        {"customer_id": f"C{rng.randrange(40):02d}", "order_id": f"O{i}", "order_date": D(2011, 1 + i % 12, 1 + i % 28), "sales": 5 + i % 97}
        for i in range(300)
    ]
    lines = make_lines(spark, rows)
    table = rfm.rfm_quintiles(lines)
    found = rows_of(table)
    assert Counter(r["f_score"] for r in found).most_common()[-1][1] >= 7
    check = rows_of(rfm.reconcile(table, lines))[0]
    assert check == {
        "customer_count_ok": True, "sales_ok": True, "profit_ok": True, "duplicate_customers": 0, "missing_scores": 0,
        "missing_segments": 0,
    }
    summary = rows_of(rfm.segment_summary(table))
    assert sum(r["customer_count"] for r in summary) == len(found)
    assert sum(r["pct_sales"] for r in summary) == pytest.approx(100, abs=0.1)


def test_equal_customers_do_not_break_the_quintiles(spark):
    lines = make_lines(spark, [{"customer_id": f"C{i}", "order_id": f"O{i}"} for i in range(10)])
    found = rows_of(rfm.rfm_quintiles(lines))
    assert {(r["r_score"], r["m_score"]) for r in found} == {(5, 1)}


def test_shares_and_running_totals_close(spark):
    rows = [{"order_id": f"O{i}", "sub_category": f"S{i % 5}", "category": f"K{i % 2}", "sales": i + 1, "order_date": D(2011, 1 + i % 12, 1)} for i in range(40)]
    lines = make_lines(spark, rows)
    shares = Counter()
    for r in rows_of(flat_suite.subcategory_share(lines)):
        shares[r["category"]] += r["subcat_share_pct"]
    assert list(shares.values()) == pytest.approx([100, 100], abs=0.05)
    last = rows_of(flat_suite.running_totals(lines))[-1]
    assert last["running_total_sales"] == sum(r["sales"] for r in rows)
    assert sum(r["sales_share"] for r in rows_of(eda.categories(lines))) == pytest.approx(100, abs=0.01)


def test_pareto_counts_equal_spend_together(spark):
    lines = make_lines(spark, [{"customer_id": f"C{i:02d}", "order_id": f"O{i}", "sales": 10 if i < 5 else 1} for i in range(20)])
    found = {r["customer_rank"]: r for r in rows_of(flat_suite.customer_pareto(lines))}
    assert sorted(found) == [1, 2, 4, 10, 20]
    assert found[1]["cumulative_sales"] == 50.0 and found[10]["cumulative_sales"] == 65.0


def test_correlation_matrix(spark):
    rng = random.Random(2)
    rows = [{"sales": rng.randrange(100), "quantity": rng.randrange(9), "profit": rng.randrange(50), "shipping_days": rng.randrange(7), "discount": rng.randrange(9) / 10} for _ in range(60)]
    matrix = {(r["column_a"], r["column_b"]): r["correlation"] for r in rows_of(eda.correlation_matrix(make_lines(spark, rows)))}
    names = eda.CORRELATED
    expected = np.corrcoef([[float(r[n]) for r in rows] for n in names])
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert matrix[a, b] == pytest.approx(expected[i][j], abs=1e-6)


def test_three_month_average_of_daily_totals(spark):
    rows = [{"order_id": f"O{i}", "order_date": D(2011, 1, 1) + datetime.timedelta(days=3 * i), "ship_date": D(2011, 1, 1) + datetime.timedelta(days=3 * i + 1), "sales": i + 1} for i in range(60)]
    lines = make_lines(spark, rows)
    calendar = star.dim_date(lines)
    found = {r["year_month"]: r for r in rows_of(measures.sales_3m_average(lines, calendar))}
    last = max(r["ship_date"] for r in rows)
    start = (last.replace(month=last.month - 3))
    days = [r["sales"] for r in rows if start < r["order_date"] <= last]
    assert found[last.strftime("%Y-%m")]["sales_3m_daily_avg"] == round(sum(days) / len(days), 2)


def test_filters(spark):
    lines = make_lines(spark, [{"order_date": D(2011, m, 1), "order_id": f"O{m}", "market": "EU" if m % 2 else "US"} for m in range(1, 13)])
    context = FilterContext(year=2011, market="EU", quarter="all", region="", start_date="2011-03-01", end_date=D(2011, 9, 1))
    assert context.apply(lines).count() == 4
    assert FilterContext(order_status="Returned").apply(lines).count() == 0
    plan = context.apply(lines.select("order_date", "year", "market", "order_id"))
    assert len(context.predicates()) == 4 and plan.columns == ["order_date", "year", "market", "order_id"]


def test_options_cover_every_value(spark):
    lines = make_lines(spark, [{"country": "Spain"}, {"country": None, "ship_mode": ""}])
    options = {(r["field"], r["value"]) for r in rows_of(service.filter_options(lines))}
    assert ("country", "Spain") in options and ("month", "March") in options and ("min_date", "2011-01-03") in options
    assert not any(value in (None, "") for _, value in options)


def test_customer_dimension_has_one_row_per_id(spark):
    lines = make_lines(spark, [{"customer_name": "Ann"}, {"customer_name": "Anna", "order_id": "O2", "sales": 50}, {"customer_id": "C2"}])
    customers = star.dim_customer(lines, rfm.rfm_quintiles(lines)).collect()
    assert sorted(r["customer_id"] for r in customers) == ["C1", "C2"]
    assert next(r for r in customers if r["customer_id"] == "C1")["monetary"] == 50
