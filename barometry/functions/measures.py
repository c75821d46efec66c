"""Row-level measures and classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as s


def percent_change(first: Column | str, last: Column | str) -> Column:
    """``100 * (last - first) / first`` to four places; null when ``first`` is 0."""
    first = F.col(first) if isinstance(first, str) else first
    last = F.col(last) if isinstance(last, str) else last
    return F.round(100 * F.try_divide(last - first, first), 4)


def money_flow_multiplier() -> Column:
    """Where the close sits in the day's range, from -1 (low) to 1 (high).

    Zero for a day without range and for a day whose high or low is unknown.
    """
    high, low, close = F.col(s.HIGH), F.col(s.LOW), F.col(s.CLOSE)
    position = F.try_divide((close - low) - (high - close), high - low)
    return F.when(high - low != 0, position).otherwise(F.lit(0.0))


def stability_class(deviation: Column | str) -> Column:
    """Class of the standard deviation of a return; null when it is unknown."""
    d = F.col(deviation) if isinstance(deviation, str) else deviation
    # Class limits and names.
    return (
        F.when(d <= 1, "Very Stable")
        .when(d <= 2, "Stable")
        .when(d <= 3, "Unstable")
        .when(d.isNotNull(), "Very Unstable")
    )


def sign_class(value: Column | str) -> Column:
    """positive, negative or neutral, judged after rounding to two places."""
    v = F.round(value, 2)
    return F.when(v > 0, "positive").when(v < 0, "negative").when(v == 0, "neutral")


def rsi_zone(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    # The usual 70 / 30 limits.
    return F.when(v > 70, "overbought").when(v < 30, "oversold").when(v.isNotNull(), "normal")


def sharpe_band(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    # Limits 1, 2 and 3.
    return (
        F.when(v >= 3, "excellent")
        .when(v >= 2, "good")
        .when(v >= 1, "acceptable")
        .when(v.isNotNull(), "below threshold")
    )


def volume_signal(ratio: Column | str) -> Column:
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(r > 1, "above usual").when(r < 1, "below usual").when(r == 1, "usual")


def display_number(value: Column | str) -> Column:
    """Two decimals, no grouping of thousands."""
    value = F.col(value) if isinstance(value, str) else value
    return F.call_function("format_number", value, F.lit("0.00"))


def display_date(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd")
