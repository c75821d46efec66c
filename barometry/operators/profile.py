"""Descriptive statistics, coverage, gaps and history of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as s

_QUARTILES = [0.25, 0.5, 0.75]


def _describe(name: str, approximate: bool, digits: int) -> Column:
    shares = F.array(*[F.lit(q) for q in _QUARTILES])
    points = F.percentile_approx(name, _QUARTILES, 10000) if approximate else F.percentile(name, shares)
    parts = {
        "mean": F.avg(name),
        "std": F.stddev_samp(name),
        "min": F.min(name),
        "p25": points[0],
        "median": points[1],
        "p75": points[2],
        "max": F.max(name),
    }
    return F.struct(*[F.round(value, digits).alias(key) for key, value in parts.items()])


def price_describe(bars: DataFrame, approximate: bool = False, digits: int = 2) -> DataFrame:
    """Mean, deviation, extremes and quartiles of the prices: a row per ticker and column.

    The bars are aggregated once for all four columns; only the result is turned
    into rows.  Exact quartiles keep a ticker's distinct prices in memory, which is
    at most one per calendar day; ``approximate`` replaces them by a sketch.
    """
    columns = [_describe(name, approximate, digits).alias(f"{name}_stats") for name in s.PRICES]
    stats = bars.groupBy(s.TICKER).agg(*columns)
    rows = [F.struct(F.lit(name).alias("column"), F.col(f"{name}_stats.*")) for name in s.PRICES]
    return stats.select(s.TICKER, F.inline(F.array(*rows)))


def coverage_columns() -> list[Column]:
    """Aggregates from which :func:`with_coverage` derives the coverage."""
    return [
        F.count(F.lit(1)).alias("observations"),
        F.min(s.DATE).alias("first_date"),
        F.max(s.DATE).alias("last_date"),
    ]


def _weekend_days_until(date: Column) -> Column:
    """Saturdays and Sundays up to a date, counted from a fixed Monday."""
    days = F.unix_date(date) + 3  # 1969-12-29, three days before day 0, was a Monday
    return F.floor(days / 7) * 2 + F.greatest(F.pmod(days, F.lit(7)) - 4, F.lit(0))


def _holidays_on_weekdays(first: Column, last: Column) -> Column:
    """Christmas and New Year days from Monday to Friday between two dates."""

    def dates_of(year: Column) -> Column:
        return F.array(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(25)))

    days = F.flatten(F.transform(F.sequence(F.year(first), F.year(last)), dates_of))
    return F.size(F.filter(days, lambda day: day.between(first, last) & (F.weekday(day) < 5)))


def with_coverage(df: DataFrame) -> DataFrame:
    """Add span, missing shares and the mean gap to first date, last date and count.

    Days off are counted from the two dates alone, without listing the days.  The
    mean gap is the span between the ends over the number of steps, which is the
    mean difference of consecutive rows.
    """
    first, last, n = F.col("first_date"), F.col("last_date"), F.col("observations")
    span = F.date_diff(last, first) + 1
    weekend = _weekend_days_until(last) - _weekend_days_until(F.date_sub(first, 1))
    working = span - weekend - _holidays_on_weekdays(first, last)
    return df.withColumns(
        {
            "span_days": span,
            "missing_pct": 100 * (1 - F.try_divide(n, span)),
            "business_days": working.cast("int"),
            "business_missing_pct": 100 * (1 - F.try_divide(n, working)),
            "mean_gap_days": F.try_divide(F.date_diff(last, first), n - 1),
        }
    )


def coverage(bars: DataFrame) -> DataFrame:
    """How much of the calendar, and of the working days, the bars of a ticker cover.

    Working days leave out weekends, December 25 and January 1.
    """
    return with_coverage(bars.groupBy(s.TICKER).agg(*coverage_columns())).drop("mean_gap_days")


def mean_gap(bars: DataFrame) -> DataFrame:
    """Mean number of days between consecutive bars of a ticker."""
    ends = with_coverage(bars.groupBy(s.TICKER).agg(*coverage_columns()))
    return ends.select(s.TICKER, "observations", "mean_gap_days")


def date_gaps(bars: DataFrame) -> DataFrame:
    """Days since the ticker's previous bar; null on its first."""
    previous = F.lag(s.DATE).over(Window.partitionBy(s.TICKER).orderBy(s.DATE))
    return bars.select(s.TICKER, s.DATE, F.date_diff(s.DATE, previous).alias("gap_days"))


def history_tail(bars: DataFrame, k: int = 5) -> DataFrame:
    """The latest ``k`` bars of each ticker, numbered from the newest.

    Spark keeps ``k`` rows per ticker already before the shuffle.
    """
    newest = Window.partitionBy(s.TICKER).orderBy(F.desc(s.DATE))
    return bars.withColumn("row", F.row_number().over(newest)).filter(F.col("row") <= k)
