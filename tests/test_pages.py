from __future__ import annotations

import pytest

import __spark_entry__ as registry
from barometry import Period, plans
from barometry.sources import union_bars
from helpers import SMALL, closes, companies, day, flat, table


@pytest.fixture(scope="module")
def market(spark):
    df = union_bars(
        [
            flat(spark, "AA", [("2024-01-01", 1), ("2024-01-02", 3), ("2024-01-03", 2)]),
            flat(spark, "BB", [("2024-01-01", 2), ("2024-01-02", 9), ("2024-01-03", 0)]),
            flat(spark, "CC", [("2024-01-01", -5), ("2024-01-02", 4), ("2024-01-03", 4)]),
        ]
    )
    known = companies(spark, ("AA", "Alpha", "i", "Tech"), ("BB", "Beta", "i", "Health"), ("CC", "Gamma", "i", "Tech"))
    return df, known


def test_top_performers(market):
    rows = table(plans.top_performers(*market, sectors=["All"]), "rank")
    assert [(r["ticker"], r["stability"], r["sign"]) for r in rows] == [
        ("BB", "Very Unstable", "positive"),
        ("AA", "Very Stable", "positive"),
        ("CC", "Very Unstable", "positive"),
    ]
    assert (rows[2]["max_daily_return"], rows[2]["max_daily_return_date"]) == (4.0, day("2024-01-02"))


def test_one_sector_needs_no_sector_column(market):
    best = plans.top_performers(*market, sectors=["Tech"], n=1)
    assert "sector" not in best.columns and [r["ticker"] for r in best.collect()] == ["AA"]
    two = plans.top_performers(*market, sectors=["Tech", "Health"], n=1)
    assert two.first()["sector"] == "Health"
    returns = plans.performer_returns(market[0], best)
    assert {r["ticker"] for r in returns.collect()} == {"AA"} and returns.count() == 3


def test_dashboard(market):
    page = plans.dashboard(*market, tickers=["AA", "CC"], window=Period.MONTH, k=2)
    assert page["prices"].count() == 6 and page["history"].count() == 4 and page["statistics"].count() == 8
    summary = table(page["summary"], "ticker")
    assert [(r["company"], r["observations"], r["rising"], r["mean_gap_days"]) for r in summary] == [
        ("Alpha", 3, True, 1.0),
        ("Gamma", 3, True, 1.0),
    ]


def test_insights(market):
    page = plans.insights(market[0], ["AA", "CC"], Period.WEEK)
    counts = {name: df.count() for name, df in page.items()}
    assert counts == {
        "bars": 6, "returns": 6, "trend": 2, "sharpe": 2, "volume": 6, "volume_summary": 2, "moving_average": 6,
        "deviation": 2, "correlation": 1, "partners": 2, "ad_line": 6, "rsi": 6,
    }


@pytest.mark.parametrize(
    ("window", "scope"), [(Period.WEEK, "ticker"), (Period.MONTH, "portfolio"), (Period.YEAR, "ticker")]
)
def test_summary_agrees_with_the_single_tables(spark, window, scope):
    bars = registry.queries()["bars_lineitem"](spark, SMALL).persist()
    page = plans.insights(bars, None, window, scope=scope)
    period = window.granularity
    summary = {r["ticker"]: r for r in plans.insights_summary(bars, None, window, scope=scope).collect()}

    trend = {r["ticker"]: (r["last_return"], r["rising"]) for r in page["trend"].collect()}
    assert trend == {t: (r["last_return"], r["rising"]) for t, r in summary.items()}
    order = "date" if period is Period.DAY else "period_start"
    sharpe = {r["ticker"]: r["sharpe_ratio"] for r in page["sharpe"].orderBy(order).collect()}
    assert sharpe == pytest.approx({t: r["last_sharpe"] for t, r in summary.items() if r["last_sharpe"] is not None})
    rsi = {r["ticker"]: r["rsi_14d"] for r in page["rsi"].orderBy("date").collect()}
    assert rsi == {t: r["last_rsi"] for t, r in summary.items()}
    line = {r["ticker"]: r["ad_line"] for r in page["ad_line"].orderBy("date").collect()}
    assert line == pytest.approx({t: r["last_ad_line"] for t, r in summary.items()})
    volume = {r["ticker"]: r for r in page["volume_summary"].collect()}
    assert all(volume[t]["max_volume_date"] == r["max_volume_date"] for t, r in summary.items())
    ratios = page["volume"].groupBy("ticker").max("volume_ratio").collect()
    assert dict(map(tuple, ratios)) == {t: r["max_volume_ratio"] for t, r in summary.items()}
    bars.unpersist()


def test_one_ticker_alone(spark):
    row = plans.insights_summary(closes(spark, "AA", "2024-01-01", [1, 2]), None, Period.WEEK).first()
    assert (row["ticker"], row["top_partner"], row["last_sharpe"], row["sharpe_band"]) == ("AA", None, None, None)


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
