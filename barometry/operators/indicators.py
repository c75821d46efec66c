"""Moving average, accumulation/distribution and relative strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import schema as s
from ..functions import extremes, measures
from ..functions.periods import Period
from .returns import with_return


def _by_date() -> WindowSpec:
    return Window.partitionBy(s.TICKER).orderBy(s.DATE)


def mean_name(n: int) -> str:
    return f"{Period.DAY.return_column}_mavg_{n}d"


def difference_name(n: int) -> str:
    return f"{Period.DAY.return_column}_diff_{n}d"


def rsi_name(n: int) -> str:
    return f"rsi_{n}d"


def moving_average(
    bars: DataFrame, n: int = 3, tickers: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Mean daily return of the last ``n`` bars, and how far the day lies from it.

    The first bars of a ticker are averaged over as many as there are.
    """
    value = Period.DAY.return_column
    returns = with_return(s.only_tickers(bars, tickers), Period.DAY)
    mean = F.avg(value).over(_by_date().rowsBetween(1 - n, 0))
    return returns.withColumn(mean_name(n), mean).withColumn(
        difference_name(n), F.col(value) - F.col(mean_name(n))
    )


def deviation_columns(n: int = 3, digits: int = 4) -> list[Column]:
    """Aggregates behind :func:`deviation_summary`, for a wider ``agg``."""
    column = difference_name(n)
    return [
        F.round(F.min(column), digits).alias("min_deviation"),
        extremes.date_of_min(column).alias("min_deviation_date"),
        F.round(F.max(column), digits).alias("max_deviation"),
        extremes.date_of_max(column).alias("max_deviation_date"),
        F.round(F.avg(column), digits).alias("mean_deviation"),
    ]


def deviation_summary(averages: DataFrame, n: int = 3, digits: int = 4) -> DataFrame:
    """Extremes and mean of the distance from the moving average, per ticker."""
    return averages.groupBy(s.TICKER).agg(*deviation_columns(n, digits))


def money_flow(bars: DataFrame, tickers: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Bars with the money-flow multiplier ``mfm`` and volume ``mfv``."""
    bars = s.only_tickers(bars, tickers)
    return bars.withColumn("mfm", measures.money_flow_multiplier()).withColumn(
        "mfv", F.col("mfm") * F.col(s.VOLUME)
    )


def accumulation_distribution(
    bars: DataFrame,
    oscillator: bool = False,
    scope: str = "ticker",
    tickers: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Running sum of money-flow volume, and its distance from its running mean.

    ``scope="ticker"`` runs along each ticker.  ``scope="portfolio"`` runs along
    the dates of all tickers together; rows of one date share one value.  Bars without a
    date share one too, before all others.
    """
    flow = money_flow(bars, tickers)
    if scope == "ticker":
        flow = flow.withColumn("ad_line", F.sum("mfv").over(_by_date()))
        if oscillator:
            flow = flow.withColumn("ad_oscillator", F.col("ad_line") - F.avg("ad_line").over(_by_date()))
        return flow
    if scope != "portfolio":
        raise ValueError("scope must be 'ticker' or 'portfolio'")
    line = _portfolio_line(flow, oscillator).withColumnRenamed(s.DATE, "line_date")
    return flow.join(line, F.col(s.DATE).eqNullSafe(F.col("line_date"))).drop("line_date")


def _portfolio_line(flow: DataFrame, oscillator: bool) -> DataFrame:
    """The line of all tickers together, one row per date.

    The bars are first added up per date.  What the unpartitioned window then sees is
    one narrow row per calendar date, however many tickers there are: 36,525 rows in a century, under 4 million in the whole range of the
    date type.
    """
    daily = flow.groupBy(s.DATE).agg(F.sum("mfv").alias("flow"), F.count(F.lit(1)).alias("bars"))
    so_far = Window.orderBy(s.DATE).rowsBetween(Window.unboundedPreceding, 0)
    line = daily.withColumn("ad_line", F.sum("flow").over(so_far))
    if not oscillator:
        return line.select(s.DATE, "ad_line")
    # The mean counts a date once per bar, as a row-level running mean would.
    weight = F.when(F.col("ad_line").isNotNull(), F.col("bars"))
    mean = F.try_divide(F.sum(F.col("ad_line") * weight).over(so_far), F.sum(weight).over(so_far))
    return line.select(s.DATE, "ad_line", (F.col("ad_line") - mean).alias("ad_oscillator"))


def relative_strength(
    bars: DataFrame,
    n: int = 14,
    tickers: Sequence[str] | DataFrame | None = None,
    min_periods: int = 1,
) -> DataFrame:
    """RSI from simple means of gains and losses over the last ``n`` bars.

    A ticker's first bar counts as neither gain nor loss.  Without any loss in the
    window the index is null.  ``min_periods``, up to ``n``, blanks the first bars of
    a ticker, whose window is shorter than that.
    """
    strength = with_strength(s.only_tickers(bars, tickers), n, min_periods)
    return strength.select(s.TICKER, s.DATE, rsi_name(n))


def with_strength(bars: DataFrame, n: int = 14, min_periods: int = 1) -> DataFrame:
    """Bars with ``gain``, ``loss``, ``avg_gain``, ``avg_loss`` and the index."""
    recent = _by_date().rowsBetween(1 - n, 0)
    change = F.col(s.CLOSE) - F.lag(s.CLOSE).over(_by_date())
    moves = bars.withColumns(
        {"gain": F.when(change > 0, change).otherwise(0.0), "loss": F.when(change < 0, -change).otherwise(0.0)}
    )
    means = moves.withColumns({"avg_gain": F.avg("gain").over(recent), "avg_loss": F.avg("loss").over(recent)})
    index = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("avg_gain", "avg_loss"))
    if min_periods > 1:
        index = F.when(F.count(F.lit(1)).over(recent) >= min_periods, index)
    return means.withColumn(rsi_name(n), index)
