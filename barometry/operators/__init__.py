"""Operators: functions from DataFrame to DataFrame, without actions."""

from .correlation import (
    best_pairs,
    best_partners,
    co_moments,
    correlated_partners,
    correlation_of_moments,
    correlation_pairs,
    merge_moments,
    top_correlations,
)
from .indicators import (
    accumulation_distribution,
    deviation_summary,
    money_flow,
    moving_average,
    relative_strength,
)
from .profile import coverage, date_gaps, history_tail, mean_gap, price_describe
from .returns import (
    daily_return,
    period_return,
    price_trend,
    return_trend,
    rolling_sharpe,
    ticker_return_stats,
    top_average_returns,
)
from .volume import volume_by_period, volume_describe

__all__ = [
    "accumulation_distribution",
    "best_pairs",
    "best_partners",
    "co_moments",
    "correlated_partners",
    "correlation_of_moments",
    "correlation_pairs",
    "coverage",
    "daily_return",
    "date_gaps",
    "deviation_summary",
    "history_tail",
    "mean_gap",
    "merge_moments",
    "money_flow",
    "moving_average",
    "period_return",
    "price_describe",
    "price_trend",
    "relative_strength",
    "return_trend",
    "rolling_sharpe",
    "ticker_return_stats",
    "top_average_returns",
    "top_correlations",
    "volume_by_period",
    "volume_describe",
]
