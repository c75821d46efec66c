from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barometry import Period
from barometry import operators as op
from barometry.functions import sharpe_band, sign_class, stability_class
from barometry.sources import merge_companies, union_bars
from helpers import bars, companies, day, flat, table


def test_daily_return(spark):
    df = bars(spark, ("AA", "2024-01-01", 3, 9, 1, 4, 1), ("AA", "2024-01-02", 0, 1, 0, 1, 1), ("BB", "2024-01-01", 8, 8, 6, 6, 1))
    rows = table(op.daily_return(df), "ticker", "date")
    assert [row["daily_return"] for row in rows] == [33.3333, None, -25.0]
    assert op.daily_return(df, ["BB"]).count() == 1


def test_period_return_follows_the_date_not_the_row_order(spark):
    df = bars(
        spark,
        ("AA", "2024-01-31", 9, 9, 9, 12, 1),
        ("AA", "2024-02-01", 5, 5, 5, 5, 1),
        ("AA", "2024-01-02", 10, 10, 10, 11, 1),
    )
    rows = table(op.period_return(df, Period.MONTH), "period_start")
    assert rows[0] == {
        "ticker": "AA",
        "month_period": "2024-01",
        "period_start": day("2024-01-02"),
        "first_open": 10.0,
        "last_close": 12.0,
        "monthly_return": 20.0,
    }
    assert op.period_return(df, Period.DAY).columns[-1] == "daily_return"


def test_period_return_keeps_the_company(spark):
    df = merge_companies(flat(spark, "AA", [("2024-01-02", 1)]), companies(spark, ("AA", "Alpha", "Chips", "Tech")))
    row = op.period_return(df, Period.YEAR).first()
    assert (row["company"], row["sector"], row["yearly_return"]) == ("Alpha", "Tech", 1.0)


@pytest.fixture(scope="module")
def three(spark):
    return union_bars(
        [
            flat(spark, "AA", [("2024-01-01", 1), ("2024-01-02", 3)]),
            flat(spark, "BB", [("2024-01-01", 2), ("2024-01-02", 2)]),
            flat(spark, "CC", [("2024-01-01", -5)]),
        ]
    )


def test_top_average_returns_break_ties_by_ticker(spark, three):
    known = companies(spark, ("AA", "Alpha", "i", "s"), ("BB", "Beta", "i", "s"), ("CC", "Gamma", "i", "t"))
    rows = table(op.top_average_returns(three, Period.DAY, 2, known), "rank")
    assert [(r["rank"], r["ticker"], r["company"], r["avg_daily_return"]) for r in rows] == [
        (1, "AA", "Alpha", 2.0),
        (2, "BB", "Beta", 2.0),
    ]
    merged = merge_companies(three, known)
    assert table(op.top_average_returns(merged, Period.DAY, 2), "rank") == rows
    weekly = op.top_average_returns(merged, Period.WEEK)
    assert weekly.count() == 3 and "avg_weekly_return" in weekly.columns


def test_ticker_return_stats(spark, three):
    rows = table(op.ticker_return_stats(three), "ticker")
    assert [r["min_daily_return_date"] for r in rows] == [day("2024-01-01")] * 3
    assert [r["max_daily_return_date"] for r in rows] == [day("2024-01-02"), day("2024-01-01"), day("2024-01-01")]
    assert [r["stability"] for r in rows] == ["Stable", "Very Stable", None]
    assert rows[2]["std_daily_return"] is None


def test_extreme_returns_beyond_the_packed_range(spark):
    df = bars(
        spark,
        ("AA", "2024-01-01", 1, 1, 1, 2, 1),
        ("AA", "2024-01-02", 1e-9, 1, 1, 5, 1),
        ("AA", "2024-01-03", 1e-9, 1, 1, 4, 1),
        ("BB", "2024-01-01", 0, 1, 1, 4, 1),
    )
    rows = table(op.ticker_return_stats(df), "ticker")
    assert rows[0]["max_daily_return_date"] == day("2024-01-02")
    assert rows[0]["min_daily_return_date"] == day("2024-01-01")
    assert rows[1]["max_daily_return_date"] is None


def test_trends(spark):
    df = bars(
        spark,
        ("AA", "2024-01-03", 1, 1, 1, 9, 1),
        ("AA", "2024-01-01", 8, 1, 1, 1, 1),
        ("BB", "2024-01-01", 5, 1, 1, 5, 1),
    )
    assert [r["rising"] for r in table(op.price_trend(df), "ticker")] == [True, False]
    days = op.return_trend(op.daily_return(df), Period.DAY)
    assert [(r["last_return"], r["rising"]) for r in table(days, "ticker")] == [(800.0, True), (0.0, False)]


def test_sharpe_needs_a_full_window_with_spread(spark):
    changing = [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3), ("2024-01-04", 2)]
    constant = [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 2)]
    df = op.daily_return(union_bars([flat(spark, "AA", changing), flat(spark, "BB", constant)]))
    rows = table(op.rolling_sharpe(df, Period.DAY), "date")
    assert [(r["ticker"], r["date"].day) for r in rows] == [("AA", 3), ("AA", 4)]
    assert rows[0]["sharpe_ratio"] == pytest.approx(2 - 0.03 / 252)
    percent = table(op.rolling_sharpe(df, Period.DAY, risk_free_unit="percent"), "date")
    assert percent[0]["sharpe_ratio"] == pytest.approx(2 - 3 / 252)
    with pytest.raises(ValueError, match="risk_free_unit"):
        op.rolling_sharpe(df, Period.DAY, risk_free_unit="basis points")


def test_sharpe_skips_windows_with_an_unknown_return(spark):
    df = op.daily_return(flat(spark, "AA", [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)]))
    holed = df.withColumn("daily_return", F.when(F.col("date") != "2024-01-02", F.col("daily_return")))
    assert op.rolling_sharpe(holed, Period.DAY).count() == 0


def test_classes(spark):
    df = spark.createDataFrame([(0.004,), (1.0,), (-1.5,), (2.5,), (3.5,), (None,)], "x double")
    rows = df.select(stability_class("x"), sign_class("x"), sharpe_band("x")).collect()
    assert [r[0] for r in rows] == ["Very Stable", "Very Stable", "Very Stable", "Unstable", "Very Unstable", None]
    assert [r[1] for r in rows] == ["neutral", "positive", "negative", "positive", "positive", None]
    assert [r[2] for r in rows] == ["below threshold", "acceptable", "below threshold", "good", "excellent", None]
