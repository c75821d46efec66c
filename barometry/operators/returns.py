"""Returns per day and period, their averages, spread, trend and Sharpe ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as s
from ..functions import extremes, measures
from ..functions.periods import Period, label_of_key, period_key
from ..sources.companies import one_row_per_ticker

PERIOD_START = "period_start"


def daily_return(bars: DataFrame, tickers: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Bars with ``daily_return``: the change from open to close in percent."""
    bars = s.only_tickers(bars, tickers)
    return bars.withColumn(Period.DAY.return_column, measures.percent_change(s.OPEN, s.CLOSE))


def period_end_columns() -> list[Column]:
    """Aggregates behind :func:`period_return`, for use in a wider ``agg``."""
    return [
        F.min(s.DATE).alias(PERIOD_START),
        F.min_by(s.OPEN, s.DATE).alias("first_open"),
        F.max_by(s.CLOSE, s.DATE).alias("last_close"),
    ]


def period_return(
    bars: DataFrame,
    period: Period,
    tickers: Sequence[str] | DataFrame | None = None,
    iso: bool = False,
) -> DataFrame:
    """Return from the first open to the last close of each ticker and period.

    First and last follow the date.  Company attributes present in the bars are
    kept.  For days this is :func:`daily_return`.
    """
    if period is Period.DAY:
        return daily_return(bars, tickers)
    bars = s.only_tickers(bars, tickers)
    kept = [s.TICKER, *s.carried_columns(bars)]
    key = period_key(period, s.DATE, iso).alias("key")
    ends = bars.groupBy(*kept, key).agg(*period_end_columns())
    return ends.select(
        *kept,
        label_of_key(period, "key").alias(period.label_column),
        PERIOD_START,
        "first_open",
        "last_close",
        measures.percent_change("first_open", "last_close").alias(period.return_column),
    )


def with_return(df: DataFrame, period: Period) -> DataFrame:
    """``df`` itself if it holds the period's return, else the return computed from bars."""
    return df if period.return_column in df.columns else period_return(df, period)


def top_average_returns(
    df: DataFrame,
    period: Period = Period.DAY,
    n: int = 5,
    companies: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` tickers with the highest mean return, ranked; ties go by ticker.

    ``df`` holds returns or bars.  Without company attributes in it, ``companies``
    supplies them: the mean is taken first, so only one row per ticker is joined.  Of
    several companies of one ticker the smallest row counts.
    """
    returns = with_return(df, period)
    keys = [c for c in (s.TICKER, s.COMPANY, s.SECTOR) if c in returns.columns]
    means = returns.groupBy(*keys).agg(F.avg(period.return_column).alias(period.average_column))
    if companies is not None and len(keys) == 1:
        companies = one_row_per_ticker(companies.select(s.TICKER, s.COMPANY, s.SECTOR))
        means = means.join(companies, s.TICKER)
    return ranked(means, period.average_column, n)


def ranked(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` rows by falling ``column``, then ticker, numbered from 1.

    The number is assigned after the limit, so its window sees ``n`` rows only.
    """
    order = [F.desc_nulls_last(column), F.asc(s.TICKER)]
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def return_stats_columns(column: str = Period.DAY.return_column) -> list[Column]:
    """Aggregates behind :func:`ticker_return_stats`, for a wider ``agg``."""
    return [
        F.min(column).alias(f"min_{column}"),
        extremes.date_of_min(column).alias(f"min_{column}_date"),
        F.max(column).alias(f"max_{column}"),
        extremes.date_of_max(column).alias(f"max_{column}_date"),
        F.stddev_samp(column).alias(f"std_{column}"),
    ]


def ticker_return_stats(df: DataFrame) -> DataFrame:
    """Extremes of the daily return with their dates, its deviation and stability class."""
    column = Period.DAY.return_column
    stats = with_return(df, Period.DAY).groupBy(s.TICKER).agg(*return_stats_columns(column))
    return stats.withColumn("stability", measures.stability_class(f"std_{column}"))


def price_trend(bars: DataFrame) -> DataFrame:
    """Whether the last close lies above the first open of the table."""
    ends = bars.groupBy(s.TICKER).agg(
        F.min_by(s.OPEN, s.DATE).alias("first_open"), F.max_by(s.CLOSE, s.DATE).alias("last_close")
    )
    return ends.withColumn("rising", F.col("first_open") < F.col("last_close"))


def _start_column(returns: DataFrame) -> str:
    return PERIOD_START if PERIOD_START in returns.columns else s.DATE


def return_trend(returns: DataFrame, period: Period) -> DataFrame:
    """Whether the latest period of each ticker had a positive return."""
    last = F.max_by(period.return_column, _start_column(returns)).alias("last_return")
    return returns.groupBy(s.TICKER).agg(last).withColumn("rising", F.col("last_return") > 0)


def sharpe_column(
    period: Period,
    start: str,
    n: int = 3,
    annual_risk_free: float = 0.03,
    risk_free_unit: str = "fraction",
) -> Column:
    """Window expression behind :func:`rolling_sharpe`; ``start`` orders the periods."""
    if risk_free_unit not in ("fraction", "percent"):
        raise ValueError("risk_free_unit must be 'fraction' or 'percent'")
    rate = annual_risk_free / period.per_year * (100 if risk_free_unit == "percent" else 1)
    value = period.return_column
    recent = Window.partitionBy(s.TICKER).orderBy(start).rowsBetween(1 - n, 0)
    ratio = F.try_divide(F.avg(value).over(recent) - F.lit(rate), F.stddev_samp(value).over(recent))
    return F.when(F.count(value).over(recent) == n, ratio)


def rolling_sharpe(
    returns: DataFrame,
    period: Period,
    n: int = 3,
    annual_risk_free: float = 0.03,
    risk_free_unit: str = "fraction",
) -> DataFrame:
    """Sharpe ratio over the last ``n`` periods, in order of time.

    Returns are percentages.  The risk-free rate is used as it stands
    ("fraction") or times 100 ("percent").  Rows without a full window, or whose
    window has no spread, have no ratio and are left out.
    """
    start = _start_column(returns)
    columns = [s.TICKER, *dict.fromkeys([period.label_column, start]), period.return_column]
    ratio = sharpe_column(period, start, n, annual_risk_free, risk_free_unit)
    ratios = returns.select(*columns).withColumn("sharpe_ratio", ratio)
    return ratios.filter(F.col("sharpe_ratio").isNotNull())
