"""Correlation of daily returns between tickers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .. import schema as s
from ..functions.periods import Period
from .pearson import cell_function, moments_of_cell
from .returns import with_return

_BLOCK = 2**14  # tickers per block, at most and about
_CELLS = 2**22  # tickers of a block times dates, about
_PAIRS = "ticker_a string, ticker_b string, correlation double"
MOMENTS = ("shared", "n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")
# Sums of returns have less than 64 bits; those of squares and products may have more.
_MOMENTS = "ticker_a string, ticker_b string, " + ", ".join(
    f"{name} {'bigint' if name in MOMENTS[:4] else 'decimal(38,0)'}" for name in MOMENTS
)


def correlation_pairs(
    bars: DataFrame,
    focus: Sequence[str] | None = None,
    universe: DataFrame | None = None,
    top: int | None = None,
    partners: int | None = None,
) -> DataFrame:
    """Pearson correlation of the daily returns of every two tickers that share a date.

    ``focus`` limits the result to pairs with at least one of its tickers.  Pairs
    are named in alphabetical order.  Fewer than two common returns, or a constant
    one, give null.  Of several bars with one ticker and date the largest return
    counts.  ``universe`` is a table with a row per ticker of the bars, such as the
    companies; with it the grid has no more tickers in view than that.

    ``top`` and ``partners`` leave pairs out that are surely not among so many best
    pairs, or best partners of a ticker: no more than so many leave a cell, or a
    cell for a ticker.

    Tickers are hashed into blocks, and every pair of blocks is a cell of a grid.
    A ticker's history, packed into one row, goes to the cells of its block; pairs
    are formed and computed inside a cell, tile by tile, and never shuffled.  The grid
    grows with the number of shuffle partitions, so that all of them have work, and once
    blocks are full with the number of tickers, so that a cell does not.

    A join on the date would instead shuffle a row per pair and date, over no more
    keys than there are dates.  Inside a cell the arithmetic is done on arrays: the
    same grid with one row per pair and date in a hash aggregate took three times
    as long.
    """
    return _cells(bars, focus, universe).applyInArrow(cell_function(top, partners), _PAIRS)


def _cells(bars: DataFrame, focus: Sequence[str] | None, universe: DataFrame | None) -> GroupedData:
    """The grid: histories of tickers, grouped by the cell that forms their pairs."""
    # A bar without a ticker or date shares its date with none.
    bars = bars.filter(F.col(s.TICKER).isNotNull() & F.col(s.DATE).isNotNull())
    returns = with_return(bars, Period.DAY)
    # One row per ticker; its length is bounded by the calendar.
    histories = returns.groupBy(s.TICKER).agg(
        F.collect_list(F.unix_date(s.DATE)).alias("days"),
        F.collect_list(F.coalesce(Period.DAY.return_column, F.lit(float("nan")))).alias("values"),
    )
    # Both only shape the grid, so an estimate of the tickers will do; one pass gives both.
    span = F.coalesce(F.date_diff(F.max(s.DATE), F.min(s.DATE)) + 1, F.lit(1)).alias("days")
    counted = F.approx_count_distinct(s.TICKER).alias("tickers")
    shape = bars.agg(F.struct(span, counted).alias("shape")).scalar()
    tickers = shape["tickers"]
    if universe is not None:  # it may hold many that have no bars
        tickers = F.least(tickers, universe.agg(F.count(F.lit(1))).scalar())
    # Histories are as long as there are dates at most: a cell holds a matrix of both.
    block = F.greatest(F.least(F.lit(_BLOCK), F.floor(F.lit(_CELLS) / shape["days"])), F.lit(16))
    needed = F.greatest(F.ceil(tickers / block), F.lit(1)).cast("int")
    partitions = _partitions(bars)
    if focus is None:
        placed = _place_all(histories, F.greatest(F.lit(math.ceil(2 * math.sqrt(partitions))), needed))
    else:
        down = max(1, math.ceil(len(focus) / _BLOCK))
        across = F.greatest(F.lit(math.ceil(2 * partitions / down)), needed)
        placed = _place_focus(histories, list(focus), F.lit(down), across)
    # The number of partitions is explicit so that small input is not merged into
    # one task: the work grows with the square of what a cell receives.
    cells = placed.select("cell", "left", "mirrored", s.TICKER, "days", "values").repartition(partitions, "cell")
    return cells.groupBy("cell")


def co_moments(bars: DataFrame, focus: Sequence[str] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Sums from which the correlation of every two tickers follows, and which add up over dates.

    Per pair of :func:`correlation_pairs`: ``shared``, the dates with a bar of both, ``n``,
    those with a return of both, and over these the sums of the returns, their squares and
    products.  Returns are counted in ten-thousandths of a percent, to which daily returns
    are rounded, so that all sums are whole numbers and exact.  Stored sums of old
    dates and those of new ones give what all dates together would: see :func:`merge_moments`.
    A return of 100 million percent or more is an error.
    """
    return _cells(bars, focus, universe).applyInArrow(moments_of_cell, _MOMENTS)


def merge_moments(parts: Sequence[DataFrame]) -> DataFrame:
    """The sums over tables of :func:`co_moments` whose dates do not overlap, in any order."""
    # A part has a pair once: adding up before the shuffle would find nothing to add.
    both = reduce(DataFrame.unionByName, parts).repartition("ticker_a", "ticker_b")
    return both.groupBy("ticker_a", "ticker_b").agg(*[F.sum(name).alias(name) for name in MOMENTS])


def correlation_of_moments(moments: DataFrame) -> DataFrame:
    """``ticker_a, ticker_b, correlation`` of stored sums; null for fewer than two returns or a constant one.

    Spreads are differences of whole numbers, so that a constant is exactly that.
    """
    n = F.col("n").cast("decimal(18,0)")

    def spread(product: str, left: str, right: str) -> Column:
        return n * F.col(product) - F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)")

    a, b = spread("sum_aa", "sum_a", "sum_a"), spread("sum_bb", "sum_b", "sum_b")
    value = spread("sum_ab", "sum_a", "sum_b").cast("double") / (F.sqrt(a.cast("double")) * F.sqrt(b.cast("double")))
    return moments.select("ticker_a", "ticker_b", F.when((a > 0) & (b > 0), value).alias("correlation"))


def _partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session; some runtimes name no number."""
    named = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return int(named) if named.isdecimal() else 200


def best_pairs(bars: DataFrame, n: int = 5, focus: Sequence[str] | None = None, universe: DataFrame | None = None) -> DataFrame:
    """The ``n`` pairs with the highest correlation; no more leave a cell of the grid."""
    return top_correlations(correlation_pairs(bars, focus, universe, top=n), n)


def best_partners(bars: DataFrame, k: int, universe: DataFrame | None = None) -> DataFrame:
    """The ``k`` best partners of every ticker; no more of each leave a cell of the grid."""
    return correlated_partners(correlation_pairs(bars, None, universe, partners=k), k=k)


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(s.TICKER), blocks).cast("int")


def _cell(low: Column, high: Column) -> Column:
    """Number of the cell of two blocks, ``low`` not above ``high``."""
    return F.shiftright(high.cast("bigint") * (high + 1), 1) + low


def _place_all(histories: DataFrame, blocks: Column) -> DataFrame:
    """Send a ticker to every cell of its block: left of later blocks, right of earlier ones.

    In the cell of a block with itself every pair turns up in both orders.
    """
    rows = histories.withColumn("block", _block(blocks))
    rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), blocks)))
    block, slot = F.col("block"), F.col("slot")
    return rows.withColumns(
        {
            "left": slot > block,
            "mirrored": slot == block,
            "cell": F.when(slot > block, _cell(block, slot - 1)).otherwise(_cell(slot, block)),
        }
    )


def _place_focus(histories: DataFrame, focus: list[str], down: Column, across: Column) -> DataFrame:
    """Send a ticker to one cell per block of focus tickers, a focus ticker also to its row of cells.

    A pair of two focus tickers turns up in both orders.
    """
    rows = histories.withColumn("mirrored", F.col(s.TICKER).isin(focus))
    last_slot = F.when(F.col("mirrored"), down + across - 1).otherwise(down - 1)
    rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), last_slot)))
    slot = F.col("slot")
    left = slot >= down
    in_row = _block(down).cast("bigint") * across + slot - down
    in_column = slot.cast("bigint") * across + _block(across)
    return rows.withColumns({"left": left, "cell": F.when(left, in_row).otherwise(in_column)})


def top_correlations(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pairs with the highest correlation; ties go by name."""
    return pairs.orderBy(F.desc_nulls_last("correlation"), "ticker_a", "ticker_b").limit(n)


def correlated_partners(pairs: DataFrame, tickers: Sequence[str] | None = None, k: int | None = None) -> DataFrame:
    """Each ticker's partners, ranked by correlation; ``k`` keeps the first of each.

    With ``k`` Spark drops the rest before the shuffle.
    """
    both = F.array(
        F.struct(F.col("ticker_a").alias(s.TICKER), F.col("ticker_b").alias("partner")),
        F.struct(F.col("ticker_b").alias(s.TICKER), F.col("ticker_a").alias("partner")),
    )
    rows = s.only_tickers(pairs.select(F.inline(both), "correlation"), tickers)
    order = Window.partitionBy(s.TICKER).orderBy(F.desc_nulls_last("correlation"), "partner")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if k is None else rows.filter(F.col("rank") <= k)
