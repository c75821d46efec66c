"""Inputs beyond what the test tables hold: large values, repeated rows, gaps."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import bars, companies, day, table
from pyspark.sql import functions as F

from barometry import functions as fn
from barometry import operators as op
from barometry import plans, sources
from barometry.functions import Period
from barometry.operators.pearson import correlate_cell
from barometry.sources import sample_tables

LINES = [
    # order, line, price: beyond any packed number of cents, and with more than seven lines
    (1, 41, 500000.0),
    (1, 42, 1.0),
    (2, 9, 7.0),
    (2, 10, 8.0),
    (3, 1, 9.0),
    (9 * 10**18, 2**31 - 1, 3.5),
    (9 * 10**18, 2**31 - 1, 3.25),
]


@pytest.mark.parametrize("backwards", [False, True])
def test_line_bars_follow_order_and_line_number(spark, tmp_path, backwards):
    rows = [(o, 1, n, 1.0, p, dt.datetime(2024, 1, 2)) for o, n, p in LINES]
    tables = {
        "lineitem": spark.createDataFrame(rows[::-1] if backwards else rows, sample_tables._SCHEMAS["lineitem"]),
        "supplier": spark.createDataFrame([(1, 5)], sample_tables._SCHEMAS["supplier"]),
        "nation": spark.createDataFrame([(5, "X", 0)], sample_tables._SCHEMAS["nation"]),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    bar = sample_tables.bars_from_lineitem(spark, str(tmp_path)).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (500000.0, 500000.0, 1.0, 3.5, 7)


@pytest.mark.parametrize("value", [1e14, 1e300, 1.00004, 5.0])
@pytest.mark.parametrize("first", ["2024-01-01", "2024-01-02"])
def test_extreme_returns_have_the_earliest_date(spark, value, first):
    dates = ["2024-01-01", "2024-01-02"]
    rows = [("A", day(d), value) for d in sorted(dates, reverse=first != dates[0])] + [("A", day("2024-01-03"), value / 2)]
    returns = spark.createDataFrame(rows, "ticker string, date date, daily_return double")
    stats = op.ticker_return_stats(returns).first()
    assert stats.max_daily_return == value and stats.max_daily_return_date == day("2024-01-01")
    assert stats.min_daily_return_date == day("2024-01-03")


def test_unrounded_returns_keep_their_own_dates(spark):
    rows = [("A", day("2024-01-01"), 1.00004), ("A", day("2024-01-02"), 1.00002)]
    stats = op.ticker_return_stats(spark.createDataFrame(rows, "ticker string, date date, daily_return double")).first()
    assert (stats.min_daily_return, stats.min_daily_return_date) == (1.00002, day("2024-01-02"))


ODD = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0**52]
ODD += [1.7976931348623157e308, math.inf, 8.0, 7.999999999999999, 1e-5, 1e22, 3.0e-300, 2.0**1023, 0.1, 1 / 3, 2.0**-1074 * 3]


def test_bits_order_like_the_doubles(spark):
    rng = np.random.default_rng(3)
    any_bits = rng.integers(-(2**63), 2**63 - 1, 3000).view(np.float64)
    close = 2.0 ** rng.integers(-1070, 1020, 500) * (1 + rng.integers(-2, 3, 500) * 2.0**-52)
    numbers = [float(x) for x in [*any_bits, *close, *ODD, *(-x for x in ODD)] if x == x]
    rows = spark.createDataFrame([(x,) for x in [*numbers, math.nan, None]], "x double")
    found = {(math.inf, 1) if r.x != r.x else (r.x, 0): r.bits for r in rows.withColumn("bits", fn.ordered_bits("x")).filter("x is not null").collect()}
    in_order = [found[x] for x in sorted(found)]
    assert all(a < b for a, b in zip(in_order, in_order[1:], strict=False))
    for x in numbers:
        assert found[x, 0] == int(np.float64(abs(x)).view(np.int64)) * (1 if x > 0 else -1)
    assert rows.filter("x is null").select(fn.ordered_bits("x")).first()[0] is None


def test_dates_of_extremes_against_a_sort(spark):
    rng = np.random.default_rng(4)
    kinds = [1.25, -3.0, 1 / 3, 1e14, -1e300, math.nan, math.inf, -math.inf, 0.0, -0.0, None, 5e-324]
    rows = []
    for ticker in range(60):
        for _ in range(int(rng.integers(1, 8))):
            date = None if rng.random() < 0.1 else dt.date(1, 1, 1) + dt.timedelta(int(rng.integers(0, 3650000)))
            rows.append((str(ticker), date, kinds[int(rng.integers(0, len(kinds)))]))
    stats = spark.createDataFrame(rows, "ticker string, date date, daily_return double").groupBy("ticker")
    found = stats.agg(fn.date_of_min("daily_return").alias("low"), fn.date_of_max("daily_return").alias("high")).collect()
    assert len(found) == 60
    for row in found:
        known = [(math.inf if v != v else v, v != v, d) for t, d, v in rows if t == row.ticker and v is not None]

        def earliest(extreme, known=known):
            dates = [d for *v, d in known if v == extreme and d is not None]
            return min(dates) if dates else None

        expected = [earliest(list(pick(known, key=lambda x: x[:2])[:2])) for pick in (min, max)] if known else [None, None]
        assert [row.low, row.high] == expected


def test_plans_aggregate_by_hash(spark):
    given = bars(spark, ("A", "2024-01-01", 1, 1, 1, 1, 1))
    for df in (op.deviation_summary(op.moving_average(given)), op.ticker_return_stats(given)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_repeated_bars_and_companies_are_reported_and_reduced(spark):
    given = bars(
        spark,
        ("A", "2024-01-01", 10, 12, 9, 11, 5),
        ("A", "2024-01-01", 10, 12, 9, 11, 5),
        ("A", "2024-01-01", 9, 12, 9, 11, 5),
        ("B", "2024-01-01", 1, 1, 1, 1, 1),
    )
    known = companies(spark, ("A", "a", "i", "s"), ("A", "b", "i", "s"), ("B", "c", "i", "s"))
    report = sources.load_quality(given, known).first()
    assert (report.total_rows, report.repeated_bars, report.repeated_tickers) == (4, 2, 1)
    single = table(sources.one_bar_per_day(given), "ticker")
    assert [(r["ticker"], r["open"]) for r in single] == [("A", 9.0), ("B", 1.0)]
    assert sources.load_quality(sources.one_bar_per_day(given)).first().repeated_bars == 0
    for best in (
        op.top_average_returns(given, Period.DAY, 2, known),
        plans.top_performers(given, known, None, None, 2),
    ):
        assert [(r["ticker"], r["company"]) for r in table(best, "rank")] == [("A", "a"), ("B", "c")]
    assert plans.dashboard_summary(given, known).count() == 2


def test_correlation_of_repeated_bars_does_not_depend_on_their_order(spark):
    rng = np.random.default_rng(1)
    rows = [(t, f"2024-01-{d:02}", 100, 200, 1, 100 + float(rng.integers(1, 50)), 1) for t in "AB" for d in range(1, 9)]
    rows += [("A", "2024-01-03", 100, 200, 1, 99.0, 1), ("A", "2024-01-04", 100, 200, 1, 199.0, 1)]
    found = [op.correlation_pairs(bars(spark, *order)).first().correlation for order in (rows, rows[::-1])]
    a = [r[5] - 100 for r in rows[:8]]
    a[3] = 99.0
    assert found == pytest.approx([np.corrcoef(a, [r[5] - 100 for r in rows[8:16]])[0, 1]] * 2)


def test_prices_that_are_no_numbers_are_missing(spark):
    raw = bars(
        spark,
        ("A", "2024-01-01", 10, 12, 9, 10, 5),
        ("A", "2024-01-02", 10, 12, 9, float("nan"), 5),
        ("A", "2024-01-03", 10, 12, 9, 12, 5),
    )
    assert sources.null_counts(raw).first().close_missing == 1
    given = sources.normalise_bars(raw)
    close = next(r for r in op.price_describe(given).collect() if r["column"] == "close")
    expected = pd.Series([10, np.nan, 12]).describe().round(2)
    assert [close[n] for n in ("mean", "std", "p75", "max")] == [expected[n] for n in ("mean", "std", "75%", "max")]
    line = table(op.accumulation_distribution(given), "date")
    assert all(r["ad_line"] is None or math.isfinite(r["ad_line"]) for r in line)


def test_portfolio_line_keeps_bars_without_a_date(spark):
    given = bars(spark, ("A", "2024-01-01", 1, 3, 1, 3, 50), ("B", "2024-01-02", 1, 3, 1, 1, 20))
    given = given.unionByName(given.limit(1).withColumn("date", F.lit(None).cast("date")))
    line = table(op.accumulation_distribution(given, scope="portfolio"), "date")
    assert [r["ad_line"] for r in line] == [50.0, 100.0, 80.0]


def test_only_wanted_pairs_leave_a_cell():
    rng = np.random.default_rng(3)
    n = 30
    cell = pa.table(
        {
            "ticker": [f"T{i:02}" for i in range(n)],
            "left": [True] * n + [],
            "mirrored": [False] * n,
            "days": [list(range(20))] * n,
            "values": [rng.normal(size=20).tolist() for _ in range(n)],
        }
    )
    right = cell.set_column(1, "left", pa.array([False] * n)).set_column(2, "mirrored", pa.array([True] * n))
    both = pa.concat_tables([cell, right])
    every = correlate_cell(both).to_pylist()
    best = sorted(every, key=lambda r: (-r["correlation"], r["ticker_a"], r["ticker_b"]))
    assert len(every) == n * (n - 1) // 2
    assert sorted(map(str, correlate_cell(both, 7, None).to_pylist())) == sorted(map(str, best[:7]))
    few = correlate_cell(both, None, 2).to_pylist()
    assert len(few) <= 2 * n
    for i in range(n):
        own = [r for r in best if f"T{i:02}" in (r["ticker_a"], r["ticker_b"])][:2]
        assert all(r in few for r in own)


def test_sector_is_chosen_before_bars_are_aggregated(spark):
    given = bars(spark, ("A", "2024-01-01", 1, 1, 1, 1, 1))
    plan = plans.top_performers(given, companies(spark, ("A", "a", "i", "s")), ["s"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate [ticker") < text.index("LeftSemi")
