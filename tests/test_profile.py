from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barometry import operators as op
from helpers import bars, closes, day, table


def on_dates(spark, *dates, ticker="AA"):
    return bars(spark, *[(ticker, d, 1, 1, 1, 1, 1) for d in dates])


def test_price_describe_interpolates(spark):
    df = closes(spark, "AA", "2024-01-01", [1, 2, 3, 10])
    row = next(r for r in table(op.price_describe(df), "column") if r["column"] == "close")
    assert row == {
        "ticker": "AA", "column": "close", "mean": 4.0, "std": 4.08, "min": 1.0,
        "p25": 1.75, "median": 2.5, "p75": 4.75, "max": 10.0,
    }
    assert sorted(r["column"] for r in op.price_describe(df, approximate=True).collect()) == ["close", "high", "low", "open"]


def test_weekend_only_span_has_no_working_days(spark):
    row = op.coverage(on_dates(spark, "2024-01-06", "2024-01-07")).first()
    assert (row["span_days"], row["missing_pct"]) == (2, 0.0)
    assert (row["business_days"], row["business_missing_pct"]) == (0, None)


def test_holiday_on_a_weekend_counts_once(spark):
    row = op.coverage(on_dates(spark, "2022-12-23", "2022-12-27")).first()
    assert (row["span_days"], row["business_days"]) == (5, 3)


@settings(max_examples=25, deadline=None)
@given(st.dates(dt.date(1950, 1, 1), dt.date(2050, 1, 1)), st.integers(0, 1500))
def test_working_days_match_a_list_of_days(spark, first, length):
    last = first + dt.timedelta(days=length)
    row = op.coverage(on_dates(spark, first.isoformat(), last.isoformat())).first()
    days = pd.date_range(first, last)
    working = (days.weekday < 5) & ~days.strftime("%m-%d").isin(["12-25", "01-01"])
    assert (row["span_days"], row["business_days"]) == (length + 1, working.sum())


def test_gaps(spark):
    df = on_dates(spark, "2024-01-08", "2024-01-01", "2024-01-03").unionByName(on_dates(spark, "2024-01-01", ticker="BB"))
    assert [r["gap_days"] for r in table(op.date_gaps(df), "ticker", "date")] == [None, 2, 5, None]
    assert [r["mean_gap_days"] for r in table(op.mean_gap(df), "ticker")] == [3.5, None]


@pytest.mark.parametrize(("k", "expected"), [(2, ["2024-01-04", "2024-01-03"]), (9, ["2024-01-04", "2024-01-03", "2024-01-02", "2024-01-01"])])
def test_history_tail(spark, k, expected):
    rows = table(op.history_tail(closes(spark, "AA", "2024-01-01", [1, 2, 3, 4]), k), "row")
    assert [r["date"] for r in rows] == [day(d) for d in expected]
