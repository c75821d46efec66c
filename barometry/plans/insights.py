"""Insights into a set of tickers: returns, risk, volume, correlation, indicators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as s
from ..functions import measures
from ..functions.periods import Period, period_key
from ..operators import correlation as c
from ..operators import indicators as i
from ..operators import returns as r
from ..operators import volume as v
from ..sources.bars import cluster_by_ticker, lookback

MEAN_DAYS = 3
RSI_DAYS = 14


def insights(
    bars: DataFrame,
    tickers: Sequence[str] | DataFrame | None = None,
    window: Period = Period.WEEK,
    companies: DataFrame | None = None,
    top_n: int = 5,
    scope: str = "portfolio",
    as_of: dt.date | Column | None = None,
) -> dict[str, DataFrame]:
    """The tables behind the page, each for all chosen tickers at once.

    With ``companies`` only tickers that have one count.

    The window sets the look-back and the granularity of returns and volumes.  Each table
    derives its bars anew; :class:`~barometry.plans.Page` has them derived once.
    """
    recent = lookback(s.only_tickers(s.only_tickers(bars, tickers), companies), window, as_of)
    return insight_tables(recent, window, top_n, scope)


def insight_tables(
    recent: DataFrame, window: Period, top_n: int = 5, scope: str = "portfolio", laid_out: bool = False
) -> dict[str, DataFrame]:
    """The tables of :func:`insights` of bars that are all within the look-back."""
    period = window.granularity
    returns = r.period_return(recent, period)
    averages = i.moving_average(recent, MEAN_DAYS)
    best_pairs = c.best_pairs(recent, top_n)
    return {
        "bars": recent,
        "returns": returns,
        "trend": r.return_trend(returns, period),
        "sharpe": r.rolling_sharpe(returns, period),
        "volume": v.volume_by_period(recent, period, laid_out=laid_out),
        "volume_summary": v.volume_describe(recent),
        "moving_average": averages,
        "deviation": i.deviation_summary(averages, MEAN_DAYS),
        "correlation": best_pairs,
        "partners": c.correlated_partners(best_pairs),
        "ad_line": i.accumulation_distribution(recent, scope=scope),
        "rsi": i.relative_strength(recent, RSI_DAYS),
    }


def insights_summary(
    bars: DataFrame,
    tickers: Sequence[str] | DataFrame | None = None,
    window: Period = Period.WEEK,
    companies: DataFrame | None = None,
    digits: int = 4,
    scope: str = "portfolio",
    as_of: dt.date | Column | None = None,
) -> DataFrame:
    """One row per ticker with the latest or summary value of every insight.

    Daily values, period values and partners each need one pass over their own
    columns of the bars.  The bars are laid out by ticker, and the windows, the
    period groups and the summaries of a pass all use that layout.  ``digits`` is
    for the deviations from the moving average.
    """
    chosen = s.only_tickers(s.only_tickers(bars, tickers), companies)
    return summary_of_layout(cluster_by_ticker(lookback(chosen, window, as_of)), window, digits, scope)


def summary_of_layout(recent: DataFrame, window: Period, digits: int = 4, scope: str = "portfolio") -> DataFrame:
    """:func:`insights_summary` of bars that are all within the look-back and laid out by ticker.

    Read from a stored table, the three passes take their columns of it, and nothing is
    laid out again.
    """
    parts = [_period_summary(recent, window.granularity), _daily_summary(recent, digits, scope), _best_partner(recent)]
    return reduce(lambda left, right: left.join(right, s.TICKER, "left"), parts)


def _period_summary(bars: DataFrame, period: Period) -> DataFrame:
    """Latest return and Sharpe ratio, highest volume ratio."""
    value, start = period.return_column, r.PERIOD_START
    periods = bars.groupBy(s.TICKER, period_key(period, s.DATE).alias("key")).agg(
        *r.period_end_columns(), F.sum(s.VOLUME).alias("total_volume")
    )
    periods = periods.withColumn(value, measures.percent_change("first_open", "last_close"))
    periods = periods.withColumns(
        {"sharpe_ratio": r.sharpe_column(period, start), "volume_ratio": v.volume_ratio_column()}
    )
    rated = F.when(F.col("sharpe_ratio").isNotNull(), F.col(start))
    summary = periods.groupBy(s.TICKER).agg(
        F.max_by(value, start).alias("last_return"),
        F.max_by("sharpe_ratio", rated).alias("last_sharpe"),
        F.max("volume_ratio").alias("max_volume_ratio"),
    )
    return summary.withColumns(
        {"rising": F.col("last_return") > 0, "sharpe_band": measures.sharpe_band("last_sharpe")}
    )


def _daily_summary(bars: DataFrame, digits: int, scope: str) -> DataFrame:
    """Deviations from the moving average, volume statistics, latest A/D line and RSI."""
    daily = i.with_strength(i.moving_average(bars, MEAN_DAYS), RSI_DAYS)
    summary = i.accumulation_distribution(daily, scope=scope).groupBy(s.TICKER).agg(
        *i.deviation_columns(MEAN_DAYS, digits),
        *v.volume_describe_columns(),
        F.max_by("ad_line", s.DATE).alias("last_ad_line"),
        F.max_by(i.rsi_name(RSI_DAYS), s.DATE).alias("last_rsi"),
    )
    return summary.withColumn("rsi_zone", measures.rsi_zone("last_rsi"))


def _best_partner(bars: DataFrame) -> DataFrame:
    """The ticker whose returns correlate most."""
    partners = c.best_partners(bars, 1)
    return partners.select(
        s.TICKER, F.col("partner").alias("top_partner"), F.col("correlation").alias("top_correlation")
    )
