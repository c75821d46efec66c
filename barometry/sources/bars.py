"""Bar tables: reading, normalising, combining, laying out, looking back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as s
from ..functions.periods import Period, lookback_text


def read_bars(
    spark: SparkSession,
    paths: str | Sequence[str],
    format: str = "parquet",
    tickers: Sequence[str] | DataFrame | None = None,
    corrupt: str | None = None,
    **options: object,
) -> DataFrame:
    """Bars from any number of files or folders, read in one scan.

    A list of tickers is pushed down to the scan.  A price that is not a number is a
    missing one.  ``corrupt`` names a further column for the text of lines that cannot be
    parsed, of CSV or JSON files; see :class:`~barometry.sources.LoadCheck`.
    """
    schema = s.BARS
    if corrupt is not None:
        schema = T.StructType([*s.BARS, T.StructField(corrupt, T.StringType())])
        # With columns left out a line could pass for good.
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "columnPruning": False} | options
    reader = spark.read.schema(schema).format(format).options(**options)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _without_nan(s.only_tickers(reader.load(paths), tickers))


def _without_nan(bars: DataFrame) -> DataFrame:
    return bars.withColumns({name: F.nanvl(name, F.lit(None).cast("double")) for name in s.PRICES})


def one_bar_per_day(bars: DataFrame) -> DataFrame:
    """One row per ticker and date: of several the smallest by open, high, low, close, volume.

    Missing values come first.  For tables in which a load may be repeated; every other
    operator takes it for granted that there is one bar per ticker and date.
    """
    values = [name for name in bars.columns if name not in (s.TICKER, s.DATE)]
    bar = F.struct(*(name for name in (*s.PRICES, s.VOLUME) if name in values), *(v for v in values if v not in (*s.PRICES, s.VOLUME)))
    single = bars.groupBy(s.TICKER, s.DATE).agg(F.min(bar).alias("bar"))
    return single.select(s.TICKER, s.DATE, "bar.*").select(*bars.columns)


def normalise_bars(
    raw: DataFrame,
    date: str = s.DATE,
    ticker: str | None = None,
    round_prices: bool = False,
) -> DataFrame:
    """Vendor rows in the shape of the bar table.

    ``date`` names a date or timestamp column, of which the date is kept.
    ``ticker`` fills the ticker column of a file that holds a single ticker.  A price
    that is not a number is a missing one.
    """
    symbol = F.col(s.TICKER) if ticker is None else F.lit(ticker)
    columns = [F.to_date(date).alias(s.DATE), symbol.alias(s.TICKER)]
    for name in s.PRICES:
        price = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        columns.append((F.round(price, 2) if round_prices else price).alias(name))
    columns.append(F.col(s.VOLUME).cast("bigint").alias(s.VOLUME))
    return raw.select(*columns)


def union_bars(parts: Sequence[DataFrame]) -> DataFrame:
    """Several bar tables as one, columns matched by name."""
    return reduce(DataFrame.unionByName, parts)


def cluster_by_ticker(bars: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash layout by ticker, shared by every later window or group on the ticker.

    Without ``partitions`` Spark sizes the result at run time.
    """
    if partitions is None:
        return bars.repartition(s.TICKER)
    return bars.repartition(partitions, s.TICKER)


def lookback(bars: DataFrame, window: Period | None, as_of: dt.date | Column | None = None) -> DataFrame:
    """The latest part of the table: 1 or 5 trading dates, or 1, 3 or 12 months.

    ``as_of`` defaults to the table's last date.  The limit is a scalar subquery,
    so it becomes a plain date filter of the scan instead of a join.
    """
    code = lookback_text(window)
    if code.endswith("d"):
        dates = bars.select(s.DATE).distinct()
        if as_of is not None:
            dates = dates.filter(F.col(s.DATE) <= F.lit(as_of))
            bars = bars.filter(F.col(s.DATE) <= F.lit(as_of))
        latest = dates.orderBy(F.desc_nulls_last(s.DATE)).limit(int(code[:-1]))
        return bars.filter(F.col(s.DATE) >= latest.agg(F.min(s.DATE)).scalar())
    months = 12 if code == "1y" else int(code[:-2])
    if as_of is None:
        end = bars.agg(F.max(s.DATE)).scalar()
    else:
        end = F.lit(as_of)
        bars = bars.filter(F.col(s.DATE) <= end)
    return bars.filter(F.col(s.DATE) > F.add_months(end, -months))
