"""Most profitable tickers of some sectors."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as s
from ..functions import measures
from ..functions.periods import Period
from ..operators import returns as r
from ..sources.bars import lookback
from ..sources.companies import in_sectors, one_row_per_ticker


def top_performers(
    bars: DataFrame,
    companies: DataFrame,
    sectors: Sequence[str] | None = None,
    window: Period | None = Period.WEEK,
    n: int = 4,
    as_of: dt.date | Column | None = None,
) -> DataFrame:
    """The ``n`` best tickers by mean daily return, with spread, stability and sign.

    Only bars of the chosen companies are aggregated, once per ticker, before companies
    are joined; of several companies of one ticker the smallest row counts.  The sector
    column is left out when a single choice makes it redundant.
    """
    value = Period.DAY.return_column
    chosen = in_sectors(one_row_per_ticker(companies.select(s.TICKER, s.COMPANY, s.SECTOR)), sectors)
    returns = r.daily_return(lookback(bars, window, as_of), chosen)
    per_ticker = returns.groupBy(s.TICKER).agg(
        F.avg(value).alias(Period.DAY.average_column), *r.return_stats_columns(value)
    )
    best = r.ranked(per_ticker.join(chosen, s.TICKER), Period.DAY.average_column, n)
    best = best.withColumns(
        {
            "stability": measures.stability_class(f"std_{value}"),
            "sign": measures.sign_class(Period.DAY.average_column),
        }
    )
    return best.drop(s.SECTOR) if sectors is not None and len(sectors) == 1 else best


def performer_returns(
    bars: DataFrame,
    best: DataFrame,
    window: Period | None = Period.WEEK,
    as_of: dt.date | Column | None = None,
) -> DataFrame:
    """Daily returns of the tickers found by :func:`top_performers`."""
    chosen = r.daily_return(lookback(bars, window, as_of), best)
    return chosen.select(s.TICKER, s.DATE, Period.DAY.return_column)
