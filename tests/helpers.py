"""Small bar tables written out by hand."""

from __future__ import annotations

import datetime as dt

from barometry import BARS, COMPANIES

SMALL = "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text)


def bars(spark, *rows):
    """Rows of (ticker, date text, open, high, low, close, volume)."""
    data = [
        (day(date), ticker, *[None if p is None else float(p) for p in prices], volume)
        for ticker, date, *prices, volume in rows
    ]
    return spark.createDataFrame(data, BARS)


def flat(spark, ticker, dates_and_returns, volume=100):
    """Bars that open at 100 and close at 100 plus the wanted return."""
    rows = [(ticker, date, 100, 100 + max(r, 0), 100 + min(r, 0), 100 + r, volume) for date, r in dates_and_returns]
    return bars(spark, *rows)


def closes(spark, ticker, start, values, volume=100):
    """Bars on consecutive days with the given closes."""
    first = day(start)
    rows = [
        (ticker, (first + dt.timedelta(days=i)).isoformat(), v, v, v, v, volume) for i, v in enumerate(values)
    ]
    return bars(spark, *rows)


def companies(spark, *rows):
    return spark.createDataFrame(list(rows), COMPANIES)


def table(df, *keys):
    """Rows as dicts, in the order of the keys."""
    return [row.asDict() for row in df.orderBy(*keys).collect()]
