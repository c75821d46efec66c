"""Checks on freshly loaded tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema as s

CORRUPT = "_corrupt_line"  # where a reader puts the text of a row that it could not parse


def load_quality(df: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row: row count, distinct tickers, and what looks wrong.

    ``expected`` is the table whose tickers the load should cover; by default the
    loaded table itself.  ``repeated_bars`` counts the rows beyond one per ticker and date,
    ``repeated_tickers`` the rows of ``expected`` beyond one per ticker if it is given.
    """
    known = df if expected is None else expected
    expected_tickers = known.agg(F.count_distinct(s.TICKER)).scalar()
    repeated = F.lit(0).cast("bigint")
    if expected is not None:
        repeated = expected.agg(F.count(s.TICKER) - F.count_distinct(s.TICKER)).scalar()
    # One row per ticker and date first: what is counted then are integers per group.
    days = df.groupBy(s.TICKER, s.DATE).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(s.TICKER).isNotNull() & F.col(s.DATE).isNotNull()
    counts = days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_distinct(s.TICKER).alias("distinct_tickers"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("repeated_bars"),
    )
    return counts.select(
        "total_rows",
        "distinct_tickers",
        (F.col("total_rows") == 0).alias("is_empty"),
        ((F.col("total_rows") > 0) & (F.col("distinct_tickers") == 0)).alias("has_no_ticker"),
        (F.col("total_rows") < expected_tickers).alias("fewer_rows_than_tickers"),
        "repeated_bars",
        repeated.alias("repeated_tickers"),
    )


def null_counts(bars: DataFrame) -> DataFrame:
    """Missing values (null or NaN) per ticker and column, and their total."""
    price_gaps = [
        F.count_if(F.col(name).isNull() | F.isnan(name)).alias(f"{name}_missing") for name in s.PRICES
    ]
    other_gaps = [F.count_if(F.col(name).isNull()).alias(f"{name}_missing") for name in (s.DATE, s.VOLUME)]
    counts = bars.groupBy(s.TICKER).agg(F.count(F.lit(1)).alias("rows"), *price_gaps, *other_gaps)
    gaps = [name for name in counts.columns if name.endswith("_missing")]
    return counts.withColumn("missing", sum(F.col(name) for name in gaps))


class LoadCheck:
    """Counts that come with the load itself, without a pass of their own.

    ``LoadCheck().watch(bars).write...`` counts what is written.  A row that the reader
    could not parse, with its text in the column ``corrupt``, is counted and left out.
    """

    def __init__(self, corrupt: str = CORRUPT) -> None:
        self._observation, self._corrupt = Observation(), corrupt

    def watch(self, bars: DataFrame) -> DataFrame:
        """``bars`` with the counting built in; to be read by one action."""
        bad = F.col(self._corrupt).isNotNull() if self._corrupt in bars.columns else F.lit(False)
        good = ~bad
        gaps = {name: F.col(name).isNull() for name in (s.TICKER, s.DATE, s.VOLUME)}
        gaps |= {name: F.col(name).isNull() | F.isnan(name) for name in s.PRICES}
        watched = bars.observe(
            self._observation,
            F.count_if(good).alias("total_rows"),
            F.count_if(bad).alias("corrupt_rows"),
            F.min(F.when(good, F.col(s.DATE))).alias("first_date"),
            F.max(F.when(good, F.col(s.DATE))).alias("last_date"),
            *[F.count_if(good & gap).alias(f"{name}_missing") for name, gap in gaps.items()],
        )
        return watched.filter(good).drop(self._corrupt)

    def report(self, spark: SparkSession) -> DataFrame:
        """One row of what was counted; waits for the action that reads the bars."""
        found = self._observation.get
        names = [f"{name}_missing" for name in (s.TICKER, s.DATE, s.VOLUME, *s.PRICES)]
        schema = "total_rows bigint, corrupt_rows bigint, first_date date, last_date date, "
        row = [found[name] for name in ("total_rows", "corrupt_rows", "first_date", "last_date", *names)]
        return spark.createDataFrame([row], schema + ", ".join(f"{name} bigint" for name in names))
