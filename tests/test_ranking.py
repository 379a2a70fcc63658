import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyworks.functions.expr import ntile_bin, quantile_bin, round_half_even, round_half_up, round_scaled
from tallyworks.operators import ranking


def skewed_values(n, seed=7):
    """A third of all rows share one value."""
    rng = random.Random(seed)
    return [(i, 50 if i % 3 == 0 else rng.randrange(1000)) for i in range(n)]


def test_positions_with_a_hot_value(spark):
    rows = skewed_values(3000)
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    found = ranking.with_position(df, [F.col("v").desc(), F.col("id")], "place", total="n").collect()
    expected = {i: p for p, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.id: r.place for r in found} == expected
    assert {r.n for r in found} == {3000}


def test_positions_of_nothing(spark):
    df = spark.createDataFrame([], "id int, v int")
    assert ranking.with_position(df, [F.col("v"), F.col("id")], "place", total="n").count() == 0


@pytest.mark.parametrize("ascending", [True, False])
def test_top_ranks_keep_all_ties(spark, ascending):
    rows = skewed_values(600, seed=3) + [(600 + i, 999 if i % 2 else 0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, v int")
    frame = pd.DataFrame(rows, columns=["id", "v"])
    for method, operator in (("dense", ranking.top_by_dense_rank), ("min", ranking.top_by_rank)):
        place = frame["v"].rank(method=method, ascending=ascending).astype(int)
        expected = {(i, p) for i, p in zip(frame["id"], place) if p <= 10}
        found = {(r.id, r.place) for r in operator(df, "v", 10, "place", ascending=ascending).collect()}
        assert found == expected


@pytest.mark.parametrize("n", [1, 2, 5, 400])
def test_percentiles_and_histogram(spark, n):
    rng = random.Random(n)
    rows = [(Decimal(rng.choice([3, 3, 3, rng.randrange(-500, 500)])) / 4, rng.randrange(5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "a decimal(18,4), b int").repartition(5)
    histogram = ranking.value_histogram(df, ["a", "b"])
    found = {r["column"]: r for r in ranking.percentiles_of(histogram, {"q1": 0.25, "mid": 0.5, "q9": 0.9}).collect()}
    for place, name in enumerate(["a", "b"]):
        values = np.array([float(r[place]) for r in rows])
        for key, p in (("q1", 0.25), ("mid", 0.5), ("q9", 0.9)):
            assert found[name][key] == pytest.approx(np.quantile(values, p), abs=1e-9)
    top = ranking.from_the_top(histogram.filter("column = 'a'")).collect()
    ordered = sorted((float(r[0]) for r in rows), reverse=True)
    for row in top:
        assert float(row.amount_down_to) == pytest.approx(sum(ordered[: row.worst]))
        assert ordered[row.best - 1] == ordered[row.worst - 1] == float(row.value)


@pytest.mark.parametrize("buckets", [60, 1 << 16])
def test_selected_quantiles(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranking, "BUCKETS", buckets)
    rng = random.Random(buckets)
    for n in (1, 400):
        rows = [(Decimal(rng.choice([3, 3, 3, rng.randrange(-500, 500)])) / 4, rng.randrange(5), None) for _ in range(n)]
        rows += [(None, 7, None), (Decimal("99999999999999.9999") if n == 400 else Decimal(0), None, None)]
        df = spark.createDataFrame(rows, "a decimal(18,4), b int, c int").repartition(5)
        found = {r["column"]: r for r in ranking.select_quantiles(df, ["a", "b", "c"], {"q0": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "q10": 1.0})}
        assert set(found) == {"a", "b"}
        for place, name in enumerate(["a", "b"]):
            values = np.array([float(r[place]) for r in rows if r[place] is not None])
            assert (found[name]["total"], found[name]["min"], found[name]["max"]) == (len(values), values.min(), values.max())
            for key, p in (("q0", 0), ("q1", 0.25), ("mid", 0.5), ("q9", 0.9), ("q10", 1)):
                assert found[name][key] == pytest.approx(np.quantile(values, p), abs=1e-9)
    assert ranking.select_quantiles(df.limit(0), ["a"], {"mid": 0.5}) == []


def test_ties_stay_where_they_are(spark):
    """No window over the rows themselves, and null values are a value."""
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 1), (5, None)], "id int, v int")
    assert {(r.id, r.place) for r in ranking.top_by_dense_rank(df, "v", 3, "place").collect()} == {(1, 1), (2, 1), (4, 2), (3, 3), (5, 3)}
    assert {(r.id, r.place) for r in ranking.top_by_rank(df, "v", 4, "place").collect()} == {(1, 1), (2, 1), (4, 3), (3, 4), (5, 4)}
    assert ranking.top_by_rank(df, "v", 4, "place").columns == ["id", "v", "place"]
    plan = ranking.top_by_rank(df, "v", 2000, "place")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=2000" in plan


def test_amount_of_top(spark):
    values = [5, 9, 9, 9, 1, 2]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    spends = ranking.from_the_top(ranking.value_histogram(df, ["v"]))
    for k in range(7):
        total = spends.agg(ranking.amount_of_top(F.col("best"), F.col("worst"), F.col("value"), F.lit(k))).first()[0]
        assert float(total) == sum(sorted(values, reverse=True)[:k])


def test_quantile_bins_equal_pandas(spark):
    sizes = [4, 5, 6, 7, 10, 11, 23, 99, 100, 397]
    rows = [(n, p) for n in sizes for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n bigint, p bigint")
    found = df.select("n", "p", quantile_bin("p", "n", 4).alias("q4"), quantile_bin("p", "n", 5).alias("q5")).toPandas()
    for n in sizes:
        part = found[found.n == n].sort_values("p")
        for bins in (4, 5):
            if n >= bins:
                expected = pd.qcut(pd.Series(range(1, n + 1)), q=bins, labels=range(1, bins + 1)).astype(int)
                assert part[f"q{bins}"].tolist() == expected.tolist()


def test_ntile_bins_equal_the_window_function(spark):
    rows = [(n, p) for n in (1, 2, 4, 5, 6, 9, 11, 103) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n bigint, p bigint")
    df.createOrReplaceTempView("places")
    found = df.select("n", "p", ntile_bin("p", "n", 5).alias("t"))
    expected = spark.sql("SELECT n, p, NTILE(5) OVER (PARTITION BY n ORDER BY p) AS t FROM places")
    assert found.exceptAll(expected).count() == 0


def test_rounding(spark):
    values = [134057.705, -9.85, 0.125, 0.375, -0.001, 2.675, 1.005, 12345678.565, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(
        "x", round_half_even("x", 2).alias("even"), round_half_up("x", 2).alias("up"), round_scaled("x", 2).alias("scaled")
    ).collect()
    for row in rows:
        assert row.even == round(row.x, 2)
        assert row.scaled == float(np.round(row.x, 2))
        exact = Decimal(row.x).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
        assert row.up == float(exact)
        assert not (row.even == 0 and math.copysign(1, row.even) < 0)
