"""Analysis periods: labels, date arithmetic, lenient parsing."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-back text per analysis window.
_LOOKBACK = {"day": "1d", "week": "5d", "month": "1mo", "quarter": "3mo", "year": "1y"}
_DEFAULT_LOOKBACK = "5d"

# Periods in a year, used to scale an annual rate.
_PER_YEAR = {"day": 252, "week": 52, "month": 12, "quarter": 4, "year": 1}

# Return column per period.
_RETURN_COLUMN = {
    "day": "daily_return",
    "week": "weekly_return",
    "month": "monthly_return",
    "quarter": "quarterly_return",
    "year": "yearly_return",
}

# Granularity at which an analysis window is summarised.
_GRANULARITY = {"day": "day", "week": "day", "month": "week", "quarter": "week", "year": "month"}


class Period(str, Enum):
    DAY = "day"
    WEEK = "week"
    MONTH = "month"
    QUARTER = "quarter"
    YEAR = "year"

    @property
    def return_column(self) -> str:
        return _RETURN_COLUMN[self.value]

    @property
    def average_column(self) -> str:
        return f"avg_{self.return_column}"

    @property
    def label_column(self) -> str:
        """Name of the column that identifies a period of this kind in results."""
        return "date" if self is Period.DAY else f"{self.value}_period"

    @property
    def per_year(self) -> int:
        return _PER_YEAR[self.value]

    @property
    def granularity(self) -> Period:
        """Return granularity shown for an analysis window of this length."""
        return Period(_GRANULARITY[self.value])


def lookback_text(window: Period | str | None) -> str:
    """Look-back code of an analysis window; anything unknown means five days."""
    return _LOOKBACK.get(getattr(window, "value", window), _DEFAULT_LOOKBACK)


def period_key(period: Period, date: Column | str, iso: bool = False) -> Column:
    """Integer that identifies the period, one to one with its label.

    Grouping on it keeps the hash key fixed-width; the text is built per group.
    For days the key is the date itself.
    """
    date = F.col(date) if isinstance(date, str) else date
    if period is Period.DAY:
        return date
    if period is Period.WEEK:
        week = F.weekofyear(date)
        if iso:
            year = F.extract(F.lit("YEAROFWEEK"), date)
        else:
            # The last days of December may belong to week 1 of the next year.  The
            # first days of January keep their own year even in week 52 or 53.
            year = F.year(date) + F.when((week == 1) & (F.month(date) == 12), 1).otherwise(0)
        return year * 100 + week
    if period is Period.MONTH:
        return F.year(date) * 100 + F.month(date)
    if period is Period.QUARTER:
        return F.year(date) * 10 + F.quarter(date)
    return F.year(date)


def label_of_key(period: Period, key: Column | str) -> Column:
    """Text form of a key made by :func:`period_key`."""
    key = F.col(key) if isinstance(key, str) else key
    if period is Period.DAY:
        return F.date_format(key, "yyyy-MM-dd")
    if period is Period.YEAR:
        return F.lpad(key.cast("string"), 4, "0")
    digits, mark = {Period.QUARTER: (1, "-Q"), Period.MONTH: (2, "-"), Period.WEEK: (2, "-W")}[period]
    base = 10**digits
    year = F.lpad(F.floor(key / base).cast("string"), 4, "0")
    number = F.lpad((key % base).cast("string"), digits, "0")
    return F.concat(year, F.lit(mark), number)


def period_label(period: Period, date: Column | str, iso: bool = False) -> Column:
    """Period label of a date: 2024, 2024-Q1, 2024-01, 2024-W01 or 2024-01-31."""
    return label_of_key(period, period_key(period, date, iso))


def add_period(date: Column | str, period: Period, amount: Column | int) -> Column:
    """Date moved by ``amount`` periods; the day is clamped to the month's end."""
    date = F.col(date) if isinstance(date, str) else date
    amount = F.lit(amount) if isinstance(amount, int) else amount
    if period is Period.DAY:
        return F.date_add(date, amount)
    if period is Period.WEEK:
        return F.date_add(date, amount * 7)
    months = 12 // period.per_year
    return F.add_months(date, amount * months)


def parse_date(text: Column | str) -> Column:
    """Date of a ``yyyy-MM-dd`` text; anything else gives null."""
    return F.try_to_date(text, "yyyy-MM-dd")
