"""Reading, checking and preparing the input tables."""

from .bars import cluster_by_ticker, lookback, normalise_bars, one_bar_per_day, read_bars, union_bars
from .companies import (
    companies_in_sectors,
    distinct_values,
    in_sectors,
    merge_companies,
    one_row_per_ticker,
    read_companies,
)
from .quality import CORRUPT, LoadCheck, load_quality, null_counts
from .store import BarStore, Scratch

__all__ = [
    "CORRUPT",
    "BarStore",
    "LoadCheck",
    "Scratch",
    "cluster_by_ticker",
    "companies_in_sectors",
    "distinct_values",
    "in_sectors",
    "load_quality",
    "lookback",
    "merge_companies",
    "normalise_bars",
    "null_counts",
    "one_bar_per_day",
    "one_row_per_ticker",
    "read_bars",
    "read_companies",
    "union_bars",
]
