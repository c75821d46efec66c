"""Traded volume per ticker and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as s
from ..functions import extremes
from ..functions.periods import Period, label_of_key, period_key


def volume_by_period(
    bars: DataFrame,
    period: Period,
    tickers: Sequence[str] | DataFrame | None = None,
    iso: bool = False,
    laid_out: bool = False,
) -> DataFrame:
    """Volume statistics per ticker and period.

    ``volume_ratio`` compares a period's total with the mean total of its ticker,
    a window over the already aggregated periods.  ``laid_out`` says that the bars of a
    ticker are together already, as those of a :class:`~barometry.sources.BarStore` are.
    """
    bars = s.only_tickers(bars, tickers)
    if period is Period.DAY:
        # Daily groups do not shrink the input.  One layout by ticker serves both
        # the grouping and the window; otherwise every bar would move twice.
        bars = bars if laid_out else bars.repartition(s.TICKER)
        # All bars of a group have its date.
        extreme_dates = []
        label, min_date, max_date = F.col("key"), F.col("key"), F.col("key")
    else:
        extreme_dates = [
            extremes.date_of_min_count(s.VOLUME).alias("min_volume_date"),
            extremes.date_of_max_count(s.VOLUME).alias("max_volume_date"),
        ]
        label = label_of_key(period, "key")
        min_date, max_date = F.col("min_volume_date"), F.col("max_volume_date")
    totals = bars.groupBy(s.TICKER, period_key(period, s.DATE, iso).alias("key")).agg(
        F.sum(s.VOLUME).alias("total_volume"),
        F.min(s.VOLUME).alias("min_volume"),
        F.max(s.VOLUME).alias("max_volume"),
        *extreme_dates,
        F.round(F.avg(s.VOLUME), 4).alias("avg_volume"),
        F.round(F.stddev_samp(s.VOLUME), 4).alias("volume_volatility"),
    )
    with_mean = totals.withColumn("avg_total_volume_per_ticker", _mean_total())
    return with_mean.select(
        s.TICKER,
        label.alias(period.label_column),
        "total_volume",
        "min_volume",
        "max_volume",
        min_date.alias("min_volume_date"),
        max_date.alias("max_volume_date"),
        "avg_volume",
        "volume_volatility",
        "avg_total_volume_per_ticker",
        F.round(F.try_divide("total_volume", "avg_total_volume_per_ticker"), 4).alias("volume_ratio"),
    )


def _mean_total() -> Column:
    return F.avg("total_volume").over(Window.partitionBy(s.TICKER))


def volume_ratio_column() -> Column:
    """Window expression of the volume ratio, for periods that hold ``total_volume``."""
    return F.round(F.try_divide("total_volume", _mean_total()), 4)


def volume_describe_columns() -> list[Column]:
    """Aggregates behind :func:`volume_describe`, for use in a wider ``agg``."""
    return [
        F.min(s.VOLUME).alias("min_volume"),
        extremes.date_of_min_count(s.VOLUME).alias("min_volume_date"),
        F.max(s.VOLUME).alias("max_volume"),
        extremes.date_of_max_count(s.VOLUME).alias("max_volume_date"),
        F.round(F.avg(s.VOLUME), 4).alias("mean_volume"),
        F.round(F.stddev_samp(s.VOLUME), 4).alias("std_volume"),
    ]


def volume_describe(bars: DataFrame) -> DataFrame:
    """Volume extremes with their dates, mean and deviation per ticker."""
    return bars.groupBy(s.TICKER).agg(*volume_describe_columns())
