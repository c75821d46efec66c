"""Column names, table schemas and the schema check."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "date"
TICKER = "ticker"
OPEN = "open"
HIGH = "high"
LOW = "low"
CLOSE = "close"
VOLUME = "volume"
COMPANY = "company"
INDUSTRY = "industry"
SECTOR = "sector"

PRICES = (OPEN, HIGH, LOW, CLOSE)
BAR_COLUMNS = (DATE, TICKER, *PRICES, VOLUME)
COMPANY_COLUMNS = (TICKER, COMPANY, INDUSTRY, SECTOR)

# One row per (ticker, date).  A ticker therefore has at most one row per
# calendar day, which is what bounds every window partitioned by ticker.
BARS = T.StructType(
    [T.StructField(DATE, T.DateType()), T.StructField(TICKER, T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in PRICES]
    + [T.StructField(VOLUME, T.LongType())]
)

COMPANIES = T.StructType([T.StructField(name, T.StringType()) for name in COMPANY_COLUMNS])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise if one of ``names`` is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def only_tickers(df: DataFrame, tickers: Sequence[str] | DataFrame | None) -> DataFrame:
    """Keep the rows of some tickers; None or an empty list keeps all.

    A list becomes an ``IN`` predicate that reaches the scan.  A DataFrame with a
    ticker column becomes a semi join; Spark broadcasts it when it measures small.
    """
    if tickers is None:
        return df
    if isinstance(tickers, DataFrame):
        return df.join(tickers.select(TICKER), TICKER, "left_semi")
    if not tickers:
        return df
    return df.filter(F.col(TICKER).isin(list(tickers)))


def carried_columns(df: DataFrame) -> list[str]:
    """Company attributes present in ``df``; they depend on the ticker alone."""
    return [name for name in (COMPANY, INDUSTRY, SECTOR) if name in df.columns]


def packed(major: Column, minor: Column, minor_digits: int) -> Column:
    """One decimal that sorts like the pair (``major``, ``minor``).

    Both are integers, ``minor`` having at most ``minor_digits`` digits.  A decimal
    has a fixed width in the aggregation buffer, so ``min_by``/``max_by`` on it stay
    in the hash aggregate; a struct would turn them into a sort of all input rows.
    """
    step = F.lit(Decimal(10**minor_digits))
    return major.cast("decimal(19,0)") * step + minor.cast(f"decimal({minor_digits},0)")
