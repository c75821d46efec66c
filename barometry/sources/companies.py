"""Company table: reading, cleaning, selecting by sector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as s

ALL_SECTORS = "All"


def read_companies(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Companies from delimited text with a header line.

    Names and types come from the schema, so a byte-order mark in the header is
    harmless; the header must not be matched against the schema for that reason.
    """
    reader = spark.read.schema(s.COMPANIES).option("sep", sep).option("header", True)
    raw = reader.option("enforceSchema", True).csv(path)
    return raw.select(s.COMPANY, s.TICKER, s.INDUSTRY, s.SECTOR)


def one_row_per_ticker(companies: DataFrame) -> DataFrame:
    """Companies with duplicate tickers reduced to their smallest row."""
    attributes = [name for name in companies.columns if name != s.TICKER]
    smallest = F.min(F.struct(*attributes)).alias("row")
    return companies.groupBy(s.TICKER).agg(smallest).select(s.TICKER, "row.*")


def in_sectors(companies: DataFrame, sectors: Sequence[str] | None = None) -> DataFrame:
    """Companies of the chosen sectors; none chosen, or "All" among them, means every one."""
    if sectors and ALL_SECTORS not in sectors:
        return companies.filter(F.col(s.SECTOR).isin(list(sectors)))
    return companies


def companies_in_sectors(companies: DataFrame, sectors: Sequence[str] | None = None) -> DataFrame:
    """Ticker and name of the companies of the chosen sectors."""
    return in_sectors(companies, sectors).select(s.TICKER, s.COMPANY)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column, such as the sectors or the tickers."""
    return df.select(column).distinct()


def merge_companies(bars: DataFrame, companies: DataFrame, unique: bool = True) -> DataFrame:
    """Bars with the attributes of their company; bars without a company are dropped.

    No join hint: the company table grows with the number of tickers, so Spark
    decides on its measured size whether to broadcast it.  ``unique`` guards
    against duplicated companies, which would duplicate bars; switch it off for a
    table known to be clean.
    """
    s.require_columns(bars, s.BAR_COLUMNS)
    s.require_columns(companies, [s.TICKER])
    if unique:
        companies = one_row_per_ticker(companies)
    return bars.join(companies, s.TICKER, "inner")
