"""The shape of the physical plans."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as registry
from barometry import Period
from barometry import operators as op
from helpers import SMALL

# Queries over texts are a part of their own, with tests of their own.
QUERIES = {name: query for name, query in registry.queries().items() if not re.match(r"op\d+_|pipeline$", name)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "bars")
    QUERIES["bars_lineitem"](spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_level_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    in_arrays = name.startswith(("correlat", "best_partners", "insights_partners", "insights_ticker_summary"))
    assert ("FlatMapGroupsInArrow" in plan) == in_arrays


def test_windows_over_bars_are_partitioned(bars):
    frames = [
        op.moving_average(bars),
        op.accumulation_distribution(bars, True),
        op.relative_strength(bars),
        op.rolling_sharpe(op.daily_return(bars), Period.DAY),
        op.volume_by_period(bars, Period.DAY),
        op.history_tail(bars),
        op.date_gaps(bars),
    ]
    assert not [df.columns for df in frames if "SinglePartition" in plan_of(df)]


def test_the_portfolio_window_sees_one_row_per_date(bars):
    plan = plan_of(op.accumulation_distribution(bars, True, "portfolio"))
    assert plan.count("SinglePartition") == 1
    below = plan[plan.index("SinglePartition") :]
    assert below.index("HashAggregate(keys=[date") < below.index("FileScan")


def test_shuffles(bars):
    def shuffles(df):
        return plan_of(df).count("Exchange hashpartitioning")

    assert shuffles(op.daily_return(bars)) == 0
    assert shuffles(op.period_return(bars, Period.MONTH)) == 1
    assert shuffles(op.ticker_return_stats(bars)) == 1
    assert shuffles(op.volume_by_period(bars, Period.DAY)) == 1
    assert shuffles(op.volume_by_period(bars, Period.MONTH)) == 2
    assert shuffles(op.deviation_summary(op.moving_average(bars))) == 1
    assert shuffles(op.accumulation_distribution(bars, True)) == 1
    assert shuffles(op.relative_strength(bars)) == 1
    assert shuffles(op.coverage(bars)) == 1
    assert shuffles(op.history_tail(bars)) == 1
    assert shuffles(op.correlation_pairs(bars, universe=bars)) == 2


def test_ordered_extremes_are_hash_aggregates(bars):
    for df in (op.ticker_return_stats(bars), op.volume_describe(bars), op.period_return(bars, Period.WEEK)):
        assert "SortAggregate" not in plan_of(df)


def test_top_n_is_taken_per_partition(bars):
    assert "TakeOrderedAndProject" in plan_of(op.top_average_returns(bars, Period.DAY, 3))
    assert plan_of(op.history_tail(bars)).count("WindowGroupLimit") == 2


def test_only_needed_columns_are_read(bars):
    plan = plan_of(op.ticker_return_stats(bars).select("ticker", "max_daily_return"))
    assert "ReadSchema: struct<ticker:string,open:double,close:double>" in plan
