from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barometry.functions import Period, add_period, lookback_text, parse_date, period_key, period_label
from helpers import day


def labels(spark, dates, period, iso=False):
    df = spark.createDataFrame([(day(d),) for d in dates], "date date")
    return [row[0] for row in df.select(period_label(period, "date", iso)).collect()]


YEAR_ENDS = ["2020-12-31", "2021-01-01", "2022-01-02", "2024-12-29", "2024-12-31"]


def test_week_labels_at_the_turn_of_the_year(spark):
    assert labels(spark, YEAR_ENDS, Period.WEEK) == ["2020-W53", "2021-W53", "2022-W52", "2024-W52", "2025-W01"]


def test_iso_week_labels(spark):
    assert labels(spark, YEAR_ENDS, Period.WEEK, iso=True) == [
        "2020-W53", "2020-W53", "2021-W52", "2024-W52", "2025-W01",
    ]


@pytest.mark.parametrize(
    ("period", "expected"),
    [(Period.DAY, "2024-08-09"), (Period.MONTH, "2024-08"), (Period.QUARTER, "2024-Q3"), (Period.YEAR, "2024")],
)
def test_other_labels(spark, period, expected):
    assert labels(spark, ["2024-08-09"], period) == [expected]


def test_null_date_has_no_label(spark):
    df = spark.sql("SELECT CAST(NULL AS DATE) AS date")
    row = df.select(*[period_label(p, "date").alias(p.value) for p in Period]).first()
    assert set(row) == {None}


@pytest.mark.parametrize("iso", [False, True])
def test_keys_and_labels_correspond(spark, iso):
    dates = spark.sql("SELECT explode(sequence(DATE'1999-12-20', DATE'2011-01-15')) AS date")
    for period in Period:
        pairs = dates.select(period_key(period, "date", iso).alias("key"), period_label(period, "date", iso).alias("label"))
        counts = pairs.agg(F.count_distinct("key"), F.count_distinct("label"), F.count_distinct("key", "label")).first()
        assert len(set(counts)) == 1


@pytest.mark.parametrize(
    ("date", "period", "amount", "expected"),
    [
        ("2024-01-31", Period.MONTH, 1, "2024-02-29"),
        ("2024-02-29", Period.YEAR, 1, "2025-02-28"),
        ("2023-02-28", Period.MONTH, 1, "2023-03-28"),
        ("2024-03-31", Period.QUARTER, -1, "2023-12-31"),
        ("2024-12-30", Period.WEEK, 1, "2025-01-06"),
        ("2024-03-01", Period.DAY, -1, "2024-02-29"),
    ],
)
def test_add_period(spark, date, period, amount, expected):
    df = spark.createDataFrame([(day(date), amount)], "date date, amount int")
    row = df.select(add_period("date", period, amount), add_period("date", period, F.col("amount"))).first()
    assert list(row) == [day(expected)] * 2


@settings(max_examples=15, deadline=None)
@given(st.dates(dt.date(1900, 1, 1), dt.date(2100, 1, 1)), st.integers(-60, 60))
def test_added_days_can_be_taken_away(spark, date, amount):
    df = spark.createDataFrame([(date,)], "date date")
    there = df.select(add_period("date", Period.WEEK, amount).alias("date"))
    assert there.select(add_period("date", Period.WEEK, -amount)).first()[0] == date


def test_parse_date(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-13-01",), ("soon",), (None,)], "text string")
    assert [row[0] for row in df.select(parse_date("text")).collect()] == [day("2024-01-31"), None, None, None]


def test_lookback_texts():
    assert [lookback_text(p) for p in Period] == ["1d", "5d", "1mo", "3mo", "1y"]
    assert lookback_text(None) == lookback_text("decade") == "5d"


def test_granularity_of_windows():
    assert [p.granularity.value for p in Period] == ["day", "day", "week", "week", "month"]
