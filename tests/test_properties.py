"""What must hold for any bars, on generated ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barometry import BARS, Period
from barometry import operators as op
from barometry.sources import union_bars
from helpers import closes

START = dt.date(2023, 12, 20)
PRICE = st.integers(0, 500).map(lambda cents: cents / 4)


@st.composite
def tables(draw):
    """A few tickers, each with bars on some of forty days."""
    rows = []
    for ticker in ("AA", "BB", "CC"):
        for offset in draw(st.sets(st.integers(0, 39), min_size=1, max_size=12)):
            open_, close, *ends = draw(st.tuples(PRICE, PRICE, PRICE, PRICE))
            low, high = min(open_, close, *ends), max(open_, close, *ends)
            rows.append((START + dt.timedelta(days=offset), ticker, open_, high, low, close, draw(st.integers(0, 9))))
    return rows


OPERATORS = {
    "week": lambda df: op.period_return(df, Period.WEEK),
    "stats": op.ticker_return_stats,
    "volume": lambda df: op.volume_by_period(df, Period.MONTH),
    "deviation": lambda df: op.deviation_summary(op.moving_average(df)),
    "line": lambda df: op.accumulation_distribution(df, True),
    "rsi": op.relative_strength,
    "sharpe": lambda df: op.rolling_sharpe(op.daily_return(df), Period.DAY),
    "coverage": op.coverage,
    "tail": lambda df: op.history_tail(df, 3),
}


def rows_of(df):
    """Rows as text with nine digits: sums of another order differ in the last ones."""

    def text(value):
        if isinstance(value, float):
            return f"{value:.9g}" if abs(value) > 1e-9 else "0"
        return str(value)

    return sorted(tuple(text(v) for v in row) for row in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
@settings(max_examples=2, deadline=None)
@given(rows=tables(), seed=st.integers(0, 99))
def test_order_and_strangers_change_nothing(spark, name, rows, seed):
    df = spark.createDataFrame(rows, BARS)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    again = spark.createDataFrame(shuffled, BARS).repartition(3)
    stranger = closes(spark, "ZZ", "2024-01-01", [5, 6, 4, 9])
    expected = rows_of(OPERATORS[name](df))
    found = OPERATORS[name](union_bars([again, stranger])).filter("ticker <> 'ZZ'")
    assert rows_of(found) == expected


@settings(max_examples=6, deadline=None)
@given(rows=tables())
def test_line_ends_at_the_sum_and_rsi_stays_in_range(spark, rows):
    df = spark.createDataFrame(rows, BARS)
    line = op.accumulation_distribution(df)
    ends = line.groupBy("ticker").agg(F.max_by("ad_line", "date").alias("end"), F.sum("mfv").alias("sum"))
    assert all(r["end"] == pytest.approx(r["sum"], abs=1e-9) for r in ends.collect())
    known = [r["rsi_14d"] for r in op.relative_strength(df).collect() if r["rsi_14d"] is not None]
    assert all(0 <= value <= 100 for value in known)
    flow = op.money_flow(df).agg(F.max(F.abs("mfm"))).first()[0]
    assert flow <= 1
