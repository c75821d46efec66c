"""Daily price-and-volume bars of many instruments, analysed with Spark."""

from .functions import Period
from .schema import BARS, COMPANIES

__all__ = ["BARS", "COMPANIES", "Period"]
