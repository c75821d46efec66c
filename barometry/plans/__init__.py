"""The three pages of the application as sets of DataFrames."""

from .dashboard import dashboard, dashboard_summary
from .insights import insights, insights_summary
from .page import Page
from .top_performers import performer_returns, top_performers

__all__ = [
    "Page",
    "dashboard",
    "dashboard_summary",
    "insights",
    "insights_summary",
    "performer_returns",
    "top_performers",
]
