from __future__ import annotations

import datetime as dt
import itertools
import math
import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from barometry import operators as op
from barometry.operators import correlation, pearson
from barometry.operators.pearson import _pearson_all, cell_function, correlate_cell
from barometry.sources import union_bars
from helpers import bars, closes, companies, flat, table


def pairs_of(df, *args, **kwargs):
    rows = op.correlation_pairs(df, *args, **kwargs).collect()
    found = {(r["ticker_a"], r["ticker_b"]): r["correlation"] for r in rows}
    assert len(found) == len(rows)
    return found


def by_hand(returns):
    """The same from nested dicts ticker -> date -> return, one pair at a time."""
    found = {}
    for a, b in itertools.combinations(sorted(returns), 2):
        shared = returns[a].keys() & returns[b].keys()
        if not shared:
            continue
        x, y = np.array([(returns[a][d], returns[b][d]) for d in sorted(shared)]).T
        varies = len(set(x)) > 1 and len(set(y)) > 1
        found[a, b] = np.corrcoef(x, y)[0, 1] if varies else None
    return found


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for pair, value in expected.items():
        if value is None:
            assert found[pair] is None, pair
        else:
            assert math.isclose(found[pair], value, abs_tol=1e-9), pair


@pytest.fixture(scope="module")
def market(spark):
    """Forty tickers with gaps in their dates, as a table and as dicts."""
    draw = np.random.default_rng(7)
    returns = {
        f"T{i:02d}": {f"2024-01-{d:02d}": round(float(r), 4) for d, r in zip(range(1, 29), draw.normal(size=28), strict=True) if draw.random() < 0.3}
        for i in range(40)
    }
    df = union_bars([flat(spark, t, list(days.items())) for t, days in returns.items() if days]).persist()
    computed = op.daily_return(df).collect()
    exact = {}
    for row in computed:
        exact.setdefault(row["ticker"], {})[row["date"]] = row["daily_return"]
    yield df, exact
    df.unpersist()


def test_all_pairs_match_a_loop(market):
    df, returns = market
    assert_same(pairs_of(df), by_hand(returns))


@pytest.mark.parametrize("focus", [["T00"], ["T03", "T04", "T39"], [f"T{i:02d}" for i in range(40)], ["none"]])
def test_focus_keeps_the_pairs_it_touches(market, focus):
    df, returns = market
    expected = {pair: value for pair, value in by_hand(returns).items() if set(pair) & set(focus)}
    assert_same(pairs_of(df, focus), expected)


@pytest.mark.parametrize("block", [1, 3])
def test_the_grid_does_not_change_the_result(spark, market, monkeypatch, block):
    df, returns = market
    monkeypatch.setattr("barometry.operators.correlation._BLOCK", block)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert_same(pairs_of(df), by_hand(returns))
        focus = [f"T{i:02d}" for i in range(0, 40, 3)]
        expected = {pair: value for pair, value in by_hand(returns).items() if set(pair) & set(focus)}
        assert_same(pairs_of(df, focus), expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_known_universe(spark, market):
    df, returns = market
    known = companies(spark, *[(ticker, "c", "i", "s") for ticker in returns])
    assert_same(pairs_of(df, universe=known), by_hand(returns))


def test_edges(spark):
    df = union_bars(
        [
            flat(spark, "AA", [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 4)]),
            flat(spark, "CONST", [("2024-01-01", 0.1), ("2024-01-02", 0.1), ("2024-01-03", 0.1)]),
            flat(spark, "ONCE", [("2024-01-03", 9), ("2024-02-01", 1)]),
            flat(spark, "OTHER", [("2024-03-01", 1)]),
            flat(spark, "UP", [("2024-01-01", 2), ("2024-01-02", 4), ("2024-01-03", 8)]),
            bars(spark, ("ZERO", "2024-01-01", 0, 1, 0, 1, 1), ("ZERO", "2024-01-02", 100, 1, 0, 105, 1)),
        ]
    )
    found = pairs_of(df)
    assert found["AA", "UP"] == pytest.approx(1)
    assert {pair for pair, value in found.items() if value is None} == found.keys() - {("AA", "UP")}
    assert ("AA", "ZERO") in found and ("AA", "ONCE") in found and ("AA", "OTHER") not in found


def test_bars_without_date_or_ticker_are_no_part_of_a_pair(spark):
    df = union_bars([flat(spark, t, [("2024-01-01", 1), ("2024-01-02", r), ("2024-01-03", 0)]) for t, r in (("AA", 2), ("BB", 3))])
    nameless = df.filter("ticker = 'AA'").withColumn("ticker", F.lit(None).cast("string"))
    timeless = df.limit(2).withColumn("date", F.lit(None).cast("date"))
    assert pairs_of(union_bars([df, nameless, timeless])) == pairs_of(df)


def test_single_ticker_has_no_pairs(spark):
    assert pairs_of(flat(spark, "AA", [("2024-01-01", 1)])) == {}


def test_top_and_partners(spark):
    pairs = spark.createDataFrame(
        [("A", "B", 0.5), ("A", "C", 0.9), ("B", "C", 0.5), ("C", "D", None)], "ticker_a string, ticker_b string, correlation double"
    )
    assert [tuple(r)[:2] for r in op.top_correlations(pairs, 3).collect()] == [("A", "C"), ("A", "B"), ("B", "C")]
    ranked = [(r["ticker"], r["rank"], r["partner"]) for r in table(op.correlated_partners(pairs), "ticker", "rank")]
    assert ranked == [
        ("A", 1, "C"), ("A", 2, "B"), ("B", 1, "A"), ("B", 2, "C"),
        ("C", 1, "A"), ("C", 2, "B"), ("C", 3, "D"), ("D", 1, "C"),
    ]
    first = op.correlated_partners(pairs, ["A", "C"], k=1)
    assert [(r["ticker"], r["partner"]) for r in table(first, "ticker")] == [("A", "C"), ("C", "A")]


def test_correlation_is_bounded(market):
    df, _ = market
    low, high = op.correlation_pairs(df).agg(F.min("correlation"), F.max("correlation")).first()
    assert -1 - 1e-9 <= low <= high <= 1 + 1e-9


def test_cancelling_sums_are_computed_from_the_values():
    """A series that is almost constant on the common dates, but not elsewhere."""
    x = np.array([[1e6, -3e6, 5, 5.0001, 5.0002, 5.0001, np.nan], [1e7, 2e7, 7, 7, 7, 7, 7]])
    y = np.array([[np.nan, np.nan, 1, 2, 3, 2, 9], [4, 1, 3, 5, 1, 0, 2]])
    found = _pearson_all(x, y, np.ones((2, 2), bool))
    assert found[0, 0] == pytest.approx(1, abs=1e-9)
    assert np.isnan(found[1, 0])
    assert found[0, 1] == pytest.approx(np.corrcoef(x[0, :6], y[1, :6])[0, 1])
    assert found[1, 1] == pytest.approx(np.corrcoef(x[1], y[1])[0, 1])


def test_moments_of_old_and_new_dates_add_up_to_those_of_all(spark):
    rng = np.random.default_rng(8)
    rows = []
    for ticker in "ABCDEFG":
        for i in range(60):
            if rng.random() < 0.8:
                close = None if rng.random() < 0.1 else 100 if ticker == "G" else float(rng.choice([90, 101.37, 250, 1e8]))
                rows.append((ticker, (dt.date(2024, 1, 1) + dt.timedelta(i)).isoformat(), 100, 100, 100, close, 1))
    given = bars(spark, *rows)
    old, new = given.filter("date < '2024-02-05'"), given.filter("date >= '2024-02-05'")
    whole = op.co_moments(given)
    merged = op.merge_moments([op.co_moments(new), op.co_moments(old)])
    in_order = lambda df: sorted(map(tuple, df.select(*whole.columns).collect()))
    assert in_order(merged) == in_order(whole)
    expected = {(r.ticker_a, r.ticker_b): r.correlation for r in op.correlation_pairs(given).collect()}
    found = {(r.ticker_a, r.ticker_b): r.correlation for r in op.correlation_of_moments(merged).collect()}
    assert found == pytest.approx(expected, abs=1e-9) and found["A", "G"] is None
    by_hand = {}
    known = {(t, d): round((c - 100) * 10000) for t, d, _, _, _, c, _ in rows if c is not None}
    for t, d, *_ in rows:
        for u in "ABCDEFG":
            if t < u and (t, d) in known and (u, d) in known:
                x, y = known[t, d], known[u, d]
                sums = by_hand.setdefault((t, u), [0] * 6)
                by_hand[t, u] = [a + b for a, b in zip(sums, [1, x, y, x * x, y * y, x * y], strict=True)]
    assert {(r[0], r[1]): [int(x) for x in r[3:]] for r in in_order(whole)} == by_hand


def test_large_sums_are_exact_without_a_number_object_per_pair():
    rng = np.random.default_rng(11)
    returns = np.round(rng.normal(size=(60, 20)) * 10.0 ** rng.integers(0, 7, (60, 1)), 4)
    returns[rng.random(returns.shape) < 0.2] = np.nan
    largest = 2**40 - 1
    returns[0], returns[1], returns[2] = largest / 1e4, -largest / 1e4, np.where(np.arange(20) % 2, 1, -1) * largest / 1e4
    whole, known = np.rint(np.nan_to_num(returns) * 1e4), [(~np.isnan(returns)).astype(float)]
    i, j = np.nonzero(np.ones((60, 60), bool))
    limbs = pearson._limbs(whole)
    for sums in (pearson._exact(limbs, limbs, i, j), pearson._exact_squares(limbs, known, i, j), pearson._exact(limbs, known, i, j)):
        assert {part.dtype for part in sums} == {np.dtype(np.int64)}
    cell = cell_of(returns, (np.arange(60) % 2 == 0).tolist())
    rows = [r for batch in pearson.moments_of_cell(iter(cell.to_batches())) for r in batch.to_pylist()]
    assert len(rows) == 900
    for r in rows:
        a, b = (int(r[name][1:]) for name in ("ticker_a", "ticker_b"))
        both = ~np.isnan(returns[a]) & ~np.isnan(returns[b])
        x, y = ([int(v) for v in whole[t][both]] for t in (a, b))
        squares = [sum(u * v for u, v in zip(*pair, strict=True)) for pair in ((x, x), (y, y), (x, y))]
        assert [int(r[name]) for name in correlation.MOMENTS[1:]] == [len(x), sum(x), sum(y), *squares]


def test_sums_are_shuffled_once_and_added_after_it(spark):
    moments = spark.createDataFrame([("A", "B", 2, 2, 3, 5, Decimal(5), Decimal(13), Decimal(8))], correlation._MOMENTS)
    merged = op.merge_moments([moments, moments])
    steps = re.findall(r"Exchange|HashAggregate", merged._jdf.queryExecution().sparkPlan().toString())
    assert steps == ["HashAggregate", "HashAggregate", "Exchange"]
    assert [tuple(r) for r in merged.collect()] == [("A", "B", 4, 4, 6, 10, 10, 26, 16)]


def test_returns_too_large_for_exact_sums_are_an_error(spark):
    given = closes(spark, "A", "2024-01-01", [1, 2]).union(bars(spark, ("B", "2024-01-01", 1e-3, 1, 1, 1e9, 1)))
    with pytest.raises(Exception, match="100 million percent"):
        op.co_moments(given).collect()


def cell_of(returns, left, mirrored=False):
    """A cell from a row of returns per ticker; nan stands for no bar."""
    known = [np.flatnonzero(~np.isnan(r)) for r in returns]
    return pa.table(
        {
            "ticker": [f"T{i:04}" for i in range(len(returns))],
            "left": left,
            "mirrored": pa.array([mirrored] * len(returns)),
            "days": pa.array([k.tolist() for k in known], pa.list_(pa.int32())),
            "values": [r[k].tolist() for r, k in zip(returns, known, strict=True)],
        }
    )


def odd_returns(n, days, seed):
    """Returns with gaps, outliers, constants, repeated series and some that hardly overlap."""
    rng = np.random.default_rng(seed)
    found = np.round(rng.normal(size=(n, days)) * 10.0 ** rng.integers(-2, 4, (n, 1)), 4)
    found[rng.random((n, days)) < 0.02] = 1e6
    found[rng.random((n, days)) < 0.15] = np.nan
    found[5::50] = 3.25
    found[7::90, 3:] = np.nan
    found[11::60] = found[11] + 1
    found[:, 0] = np.where(np.isnan(found).all(axis=1), 1.0, found[:, 0])
    return found


@pytest.mark.parametrize("mirrored", [False, True])
@pytest.mark.parametrize("days", [3, 20])
def test_best_pairs_of_a_large_cell_are_those_of_all_pairs(mirrored, days):
    returns = odd_returns(900, days, days)
    if mirrored:
        cell = pa.concat_tables([cell_of(returns, [True] * 900), cell_of(returns, [False] * 900, True)])
    else:
        cell = cell_of(returns, (np.arange(900) % 2 == 0).tolist())
    best = lambda rows: sorted(rows, key=lambda r: (-r["correlation"], r["ticker_a"], r["ticker_b"]))
    every = [r for r in correlate_cell(cell).to_pylist() if r["correlation"] is not None]
    assert len({(r["ticker_a"], r["ticker_b"]) for r in every}) == len(every)
    found = best(correlate_cell(cell, 40).to_pylist())
    assert [r["correlation"] for r in found] == pytest.approx([r["correlation"] for r in best(every)[:40]], abs=1e-9)
    values = {(r["ticker_a"], r["ticker_b"]): r["correlation"] for r in every}
    assert all(r["correlation"] == pytest.approx(values[r["ticker_a"], r["ticker_b"]], abs=1e-9) for r in found)


def test_best_pairs_do_not_need_the_correlation_of_every_pair(monkeypatch):
    computed = []
    whole, single = pearson._pearson_all, pearson._pearson
    monkeypatch.setattr(pearson, "_pearson_all", lambda x, y, w: computed.append(len(x) * len(y)) or whole(x, y, w))
    monkeypatch.setattr(pearson, "_pearson", lambda x, y: computed.append(len(y)) or single(x, y))
    returns = np.random.default_rng(4).normal(size=(3000, 30))
    assert correlate_cell(cell_of(returns, (np.arange(3000) < 1500).tolist()), 5).num_rows == 5
    assert sum(computed) < 0.1 * 1500 * 1500


def test_pairs_leave_a_large_cell_in_parts():
    returns = np.random.default_rng(5).normal(size=(1500, 4))
    cell = cell_of(returns, (np.arange(1500) < 700).tolist())
    sizes = [batch.num_rows for batch in cell_function(None, None)(iter(cell.to_batches()))]
    assert sum(sizes) == 700 * 800 and max(sizes) < 100_000
    few = correlate_cell(cell, None, 1).to_pylist()
    every = sorted(correlate_cell(cell).to_pylist(), key=lambda r: -r["correlation"])
    best = {t: next(r for r in every if t in (r["ticker_a"], r["ticker_b"])) for t in ("T0000", "T0699", "T1499")}
    assert all(r in few for r in best.values()) and len(few) <= 1500


@pytest.mark.parametrize("together", [2**24, 2**16, 50])
@pytest.mark.parametrize("mirrored", [False, True])
def test_pairs_in_order_are_those_of_the_tiles(monkeypatch, together, mirrored):
    returns = odd_returns(700, 12, 6)
    cell = cell_of(returns, [True] * 700)
    cell = pa.concat_tables([cell, cell_of(returns, [False] * 700, True)]) if mirrored else cell_of(returns, (np.arange(700) % 3 == 0).tolist())
    made = pearson._Cell(cell)
    names = np.array(cell["ticker"].to_pylist())
    tiles = [pearson._pairs(made, *tile) for tile in made.tiles()]
    expected = {(names[a], names[b]): v for part in tiles for a, b, v in zip(*part, strict=True)}
    monkeypatch.setattr(pearson, "_SORTED", together)
    found = correlate_cell(cell).to_pylist()
    pairs = {(r["ticker_a"], r["ticker_b"]): math.nan if r["correlation"] is None else r["correlation"] for r in found}
    assert len(pairs) == len(found) and pairs == pytest.approx(expected, nan_ok=True, abs=1e-9)


def test_pairs_of_a_cell_take_half_the_room_in_order(tmp_path):
    """Equal values follow each other once they are rounded, and a column file keeps them once."""
    returns = np.random.default_rng(9).normal(size=(4000, 30))
    pairs = correlate_cell(cell_of(returns, (np.arange(4000) < 2000).tolist()))
    values = pairs["correlation"].to_numpy()
    assert len(values) == 2000 * 2000 and (np.diff(values) > -1e-6).all()
    parquet.write_table(pairs.set_column(2, "correlation", pa.array(np.round(values, 6))), tmp_path / "pairs", row_group_size=len(values))
    assert (tmp_path / "pairs").stat().st_size < 6 * len(values)


def test_a_large_universe_does_not_multiply_the_rows_sent(spark, market):
    df, returns = market
    many = spark.range(200_000).selectExpr("concat('C', id) AS ticker")
    sent = correlation._cells(df, None, many).count().agg(F.sum("count")).first()[0]
    assert sent <= len(returns) * 8
    assert_same(pairs_of(df, universe=many), by_hand(returns))
