"""Bars and companies derived from the star-schema and event test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as s


# Columns used here.  A given schema saves the job that would look for one.
_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double, props string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _user_ticker(number: str) -> Column:
    """``U`` and the number, padded with zeros to four digits."""
    text = F.col(number).cast("string")
    return F.concat(F.lit("U"), F.lpad(text, F.greatest(F.length(text), F.lit(4)), F.lit("0")))


def bars_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """A user is a ticker; the values of a day, in order of time, make its bar."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60
    micros = seconds.cast("bigint") * 1000000 + (F.extract(F.lit("SECOND"), F.col("ts")) * 1000000).cast("bigint")
    events = _table(spark, folder, "events").select(
        "user_id",
        F.to_date("ts").alias(s.DATE),
        "value",
        # The time within the day is enough: the date is a group key.
        s.packed(micros, F.col("event_id"), 19).alias("position"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    days = events.groupBy("user_id", s.DATE).agg(
        F.min_by("value", "position").alias(s.OPEN),
        F.max("value").alias(s.HIGH),
        F.min("value").alias(s.LOW),
        F.max_by("value", "position").alias(s.CLOSE),
        F.sum("k").alias(s.VOLUME),
    )
    return days.withColumn(s.TICKER, _user_ticker("user_id")).select(*s.BAR_COLUMNS)


def companies_from_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of the event bars: customer, market segment, region."""
    customer = _table(spark, folder, "customer")
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_name").alias(s.COMPANY),
            _user_ticker("c_custkey").alias(s.TICKER),
            F.col("c_mktsegment").alias(s.INDUSTRY),
            F.col("r_name").alias(s.SECTOR),
        )
    )


def bars_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """A supplier nation is a ticker; the shipped lines of a day make its bar.

    Lines are ordered by order and line number, then price.  Lines with the same numbers
    become one first, so that one decimal of both numbers orders what is left.  The bars
    are laid out by nation and date for both steps.
    """
    lines = _table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias(s.DATE),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        "l_orderkey",
        "l_linenumber",
    )
    supplier = _table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    day = ["s_nationkey", s.DATE]
    single = (
        lines.join(supplier, "l_suppkey")
        .repartition(*day)
        .groupBy(*day, "l_orderkey", "l_linenumber")
        .agg(F.min("price").alias("lowest"), F.max("price").alias("highest"), F.sum("quantity").alias("quantity"))
        .withColumn("line", s.packed(F.col("l_orderkey"), F.col("l_linenumber"), 10))
    )
    days = single.groupBy(*day).agg(
        F.min_by("lowest", "line").alias(s.OPEN),
        F.max("highest").alias(s.HIGH),
        F.min("lowest").alias(s.LOW),
        F.max_by("highest", "line").alias(s.CLOSE),
        F.sum("quantity").cast("bigint").alias(s.VOLUME),
    )
    nation = _table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias(s.TICKER))
    return days.join(nation, "s_nationkey").select(*s.BAR_COLUMNS)


def companies_from_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of the line bars: the nation itself and its region."""
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    name, area = F.col("n_name"), F.col("r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        name.alias(s.COMPANY), name.alias(s.TICKER), area.alias(s.INDUSTRY), area.alias(s.SECTOR)
    )
