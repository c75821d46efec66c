"""A page with bars of its own: chosen and derived once, laid out by ticker, gone at the end."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import schema as s
from ..functions.periods import Period
from ..sources.store import Scratch
from .dashboard import dashboard_tables
from .insights import insight_tables, summary_of_layout


class Page:
    """The tables of the pages over one bar table, which is written when the page opens.

    ``with Page(bars, companies, window=Period.YEAR) as page:`` chooses the bars of the
    tickers that have a company (or of all tickers without companies), computes them once
    and stores them by ticker.  The limit of the look-back is taken from the stored
    table.  All tables of the page read it, each its columns, and what runs along a
    ticker needs no exchange.  Results must be collected or written before the page is
    closed; closing removes the stored bars.
    """

    def __init__(
        self,
        bars: DataFrame,
        companies: DataFrame | None = None,
        tickers: Sequence[str] | DataFrame | None = None,
        window: Period = Period.WEEK,
        as_of: dt.date | None = None,
        buckets: int | None = None,
    ) -> None:
        self.window, self.companies, self.spark = window, companies, bars.sparkSession
        self._scratch = Scratch(bars.sparkSession)
        chosen = s.only_tickers(s.only_tickers(bars, tickers), companies)
        self.store = self._scratch.store(chosen, buckets)
        self.bars = self.store.lookback(window, as_of)

    def insights(self, top_n: int = 5, scope: str = "portfolio") -> dict[str, DataFrame]:
        return insight_tables(self.bars, self.window, top_n, scope, laid_out=True)

    def insights_summary(self, digits: int = 4, scope: str = "portfolio") -> DataFrame:
        return summary_of_layout(self.bars, self.window, digits, scope)

    def dashboard(self, k: int = 5, digits: int = 2) -> dict[str, DataFrame]:
        """Needs companies, whose names it shows."""
        return dashboard_tables(self.bars, self.companies, k, digits)

    def close(self) -> None:
        self._scratch.close()

    def __enter__(self) -> Page:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
