"""Bar tables on disk, laid out for the operators: by period of the date, and by ticker.

The table is partitioned by month (or another period) and bucketed by ticker.  A limit on
the date then reads the partitions it needs, and everything that groups, joins or runs
along a ticker finds its bars together: Spark plans no exchange for it.  Neither for a join by
ticker of two tables with as many buckets, nor for one by ticker and date if
``spark.sql.requireAllClusterKeysForCoPartition`` is off.  Every bucket of a
month is one file, sorted by ticker and date, so that its row groups can be skipped too.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as s
from ..functions.periods import Period, lookback_text, period_key

PART = "part"  # the partition column: the key of the period, such as 202401


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a single machine the warehouse will do."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _spread(bars: DataFrame, buckets: int, by: Period | None) -> DataFrame:
    """One task per bucket of a partition at most, so that it gets one file.

    Spark numbers buckets by the remainder of the hash.
    """
    bucket = F.pmod(F.hash(s.TICKER), F.lit(buckets))
    if by is None:
        return bars.repartition(buckets, s.TICKER)
    return bars.withColumn(PART, period_key(by, s.DATE)).repartition(PART, bucket)


@dataclass(frozen=True)
class BarStore:
    """A stored bar table.  ``by`` is the period of its partitions, None if it has none."""

    spark: SparkSession
    table: str
    path: str
    buckets: int
    by: Period | None = Period.MONTH

    @classmethod
    def write(cls, bars: DataFrame, table: str, path: str, buckets: int = 8, by: Period | None = Period.MONTH) -> BarStore:
        """Writes ``bars`` as a new table of the session's catalog, whose files are in ``path``.

        A ticker is in one bucket whole: choose so many that a bucket of a partition makes
        a good file.  Rows without a date have a partition of their own.
        """
        s.require_columns(bars, s.BAR_COLUMNS)
        store = cls(bars.sparkSession, table, path, buckets, by)
        store._save(bars, "errorifexists")
        return store

    @classmethod
    def open(cls, spark: SparkSession, table: str, path: str, buckets: int = 8, by: Period | None = Period.MONTH) -> BarStore:
        """A table that an earlier session wrote: its layout is told again, its partitions are looked up."""
        columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in s.BARS)
        parted = "" if by is None else f"PARTITIONED BY ({PART})"
        part = "" if by is None else f", {PART} {'date' if by is Period.DAY else 'int'}"
        spark.sql(
            f"CREATE TABLE {table} ({columns}{part}) USING parquet {parted} CLUSTERED BY ({s.TICKER}) "
            f"SORTED BY ({s.TICKER}, {s.DATE}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if by is not None:
            spark.sql(f"MSCK REPAIR TABLE {table}")
        return cls(spark, table, path, buckets, by)

    def _save(self, bars: DataFrame, mode: str) -> None:
        rows = _spread(bars.select(*s.BAR_COLUMNS), self.buckets, self.by)
        writer = rows.write.format("parquet").mode(mode).option("path", self.path)
        writer = writer.bucketBy(self.buckets, s.TICKER).sortBy(s.TICKER, s.DATE)
        (writer if self.by is None else writer.partitionBy(PART)).saveAsTable(self.table)

    def append(self, bars: DataFrame) -> None:
        """Adds bars of dates that the table does not have; a bucket of an old partition gets a further file."""
        self._save(bars, "append")

    def drop(self) -> None:
        """Removes the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)

    def bars(self, tickers: Sequence[str] | DataFrame | None = None, since: dt.date | None = None) -> DataFrame:
        """The bars, of some tickers, on or after a date; only the partitions from that date on are read."""
        rows = self.spark.table(self.table)
        if since is not None:
            if self.by is not None:
                rows = rows.filter(F.col(PART) >= period_key(self.by, F.lit(since)))
            rows = rows.filter(F.col(s.DATE) >= F.lit(since))
        return s.only_tickers(rows, tickers).select(*s.BAR_COLUMNS)

    def _latest_dates(self, n: int, as_of: dt.date | None) -> list[dt.date]:
        """The last ``n`` dates, newest first.  Looks into the last partitions, as many as it takes."""
        rows = self.spark.table(self.table)
        if as_of is not None:
            rows = rows.filter(F.col(s.DATE) <= F.lit(as_of))
        found: list[dt.date] = []
        for rows in self._newest_partitions(rows, as_of):
            # One row per calendar day of a partition at most, and of those n.
            newest = rows.select(s.DATE).distinct().filter(F.col(s.DATE).isNotNull()).orderBy(F.desc(s.DATE)).limit(n - len(found))
            found += [row[0] for row in newest.collect()]
            if len(found) >= n:
                break
        return found

    def _newest_partitions(self, rows: DataFrame, as_of: dt.date | None):
        if self.by is None:
            yield rows
            return
        # The names of the partitions are in the catalog, and no file is opened for them.
        names = [row[0].partition("=")[2] for row in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]
        days = self.by is Period.DAY
        parts = sorted((dt.date.fromisoformat(x) if days else int(x) for x in names if not x.startswith("__")), reverse=True)
        for part in parts:
            yield rows.filter(F.col(PART) == F.lit(part))

    def last_date(self, as_of: dt.date | None = None) -> dt.date | None:
        """The last date, up to ``as_of``; read from the last partition alone."""
        return next(iter(self._latest_dates(1, as_of)), None)

    def lookback(
        self, window: Period | None, as_of: dt.date | None = None, tickers: Sequence[str] | DataFrame | None = None
    ) -> DataFrame:
        """What :func:`barometry.sources.lookback` gives of the table, from the partitions that it needs.

        The limit is looked up first, in the last partition, and is a plain date in the plan.
        """
        code = lookback_text(window)
        if code.endswith("d"):
            latest = self._latest_dates(int(code[:-1]), as_of)
            first = latest[-1] if latest else None
        else:
            months = 12 if code == "1y" else int(code[:-2])
            end = as_of or self.last_date()
            # The day after the same day, months earlier.
            limit = F.date_add(F.add_months(F.lit(end), -months), 1)
            first = self.spark.range(1).select(limit).first()[0] if end else None
        if first is None:
            return self.bars(tickers).limit(0)
        rows = self.bars(tickers, first)
        return rows if as_of is None else rows.filter(F.col(s.DATE) <= F.lit(as_of))


class Scratch:
    """Tables that a page or a query makes for itself.  Its owner closes it, and they are gone.

    They are written to the folder that driver and executors share, so that a lost
    executor costs nothing but the task it was at.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._name = f"barometry_{uuid.uuid4().hex}"
        self._stores: list[BarStore] = []
        self.folder = f"{shared_folder(spark)}/{self._name}"

    def write(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, computed once."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store(self, bars: DataFrame, buckets: int | None = None, by: Period | None = None) -> BarStore:
        """``bars`` computed once and laid out by ticker; ``buckets`` are as many as shuffle partitions by default."""
        if buckets is None:
            named = self.spark.conf.get("spark.sql.shuffle.partitions")
            buckets = int(named) if named.isdecimal() else 200
        n = len(self._stores)
        store = BarStore.write(bars, f"{self._name}_{n}", f"{self.folder}/bars_{n}", buckets, by)
        self._stores.append(store)
        return store

    def close(self) -> None:
        for store in self._stores:
            store.drop()
        self._stores = []
        remove(self.spark, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
