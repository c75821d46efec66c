"""Dashboard of a set of tickers: candles, statistics, coverage, history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as s
from ..functions.periods import Period
from ..operators import profile
from ..sources.bars import lookback
from ..sources.companies import one_row_per_ticker


def dashboard(
    bars: DataFrame,
    companies: DataFrame,
    tickers: Sequence[str] | DataFrame | None = None,
    window: Period | None = Period.WEEK,
    k: int = 5,
    as_of: dt.date | Column | None = None,
) -> dict[str, DataFrame]:
    """The tables behind the page, each for all chosen tickers with a company at once."""
    return dashboard_tables(lookback(s.only_tickers(s.only_tickers(bars, tickers), companies), window, as_of), companies, k)


def dashboard_tables(recent: DataFrame, companies: DataFrame, k: int = 5, digits: int = 2) -> dict[str, DataFrame]:
    """The tables of :func:`dashboard` of bars that are all within the look-back."""
    return {
        "prices": recent.select(s.TICKER, s.DATE, *s.PRICES),
        "summary": dashboard_summary(recent, companies),
        "statistics": profile.price_describe(recent, digits=digits),
        "history": profile.history_tail(recent.select(s.TICKER, s.DATE, *s.PRICES), k),
    }


def dashboard_summary(bars: DataFrame, companies: DataFrame) -> DataFrame:
    """Coverage, mean gap and price trend of each ticker with a company, from one aggregation."""
    per_ticker = bars.groupBy(s.TICKER).agg(
        *profile.coverage_columns(),
        F.min_by(s.OPEN, s.DATE).alias("first_open"),
        F.max_by(s.CLOSE, s.DATE).alias("last_close"),
    )
    summary = profile.with_coverage(per_ticker)
    summary = summary.withColumn("rising", F.col("first_open") < F.col("last_close"))
    return summary.join(one_row_per_ticker(companies.select(s.TICKER, s.COMPANY)), s.TICKER)
