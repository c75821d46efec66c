"""Arithmetic of the correlation inside one cell of the grid, on arrays."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions travel to the executors with the query, so that these need no copy
# of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A spread below this share of the sum of squares is computed anew, series by series.
_CANCELLED = 1e-4
_TILE = 128, 512  # tickers of the left and right side whose pairs are held at once
_AT_ONCE = 2**12  # pairs that are computed one by one
_SORTED = 2**24  # pairs that are put into order together, 16 bytes each
_POSITION = 36  # bits for the place of a pair among these


def cell_function(top: int | None, partners: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a cell from its rows: all, as they are computed, or the best ones at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _correlated(pa.Table.from_batches(list(batches)), top, partners):
            yield from table.combine_chunks().to_batches()

    return run


def correlate_cell(table: pa.Table, top: int | None = None, partners: int | None = None) -> pa.Table:
    """Pairs of a cell: a ticker of the left side with one of the right.

    Of all, or the ``top`` best, or those with one of the ``partners`` best of a ticker.
    """
    return pa.concat_tables(_correlated(table, top, partners))


def _correlated(table: pa.Table, top: int | None, partners: int | None) -> Iterator[pa.Table]:
    """The pairs of a cell in tables: many of as many rows as a tile has, or one of the best pairs."""
    cell = _Cell(table)
    if top is not None:
        yield cell.table(*_top(cell, top))
        return
    if partners is None:
        for rows, columns in cell.stretches():
            for pairs in _in_order(cell, rows, columns):
                yield cell.table(*pairs)
        return
    best, most = [_pairs(cell, cell.lefts[:0], cell.rights[:0])], 0
    for rows, columns in cell.tiles():
        best.append(_chosen(cell, _pairs(cell, rows, columns), None, partners))
        if sum(len(x[0]) for x in best) > 2 * most + _TILE[0] * _TILE[1]:
            best = [_chosen(cell, _joined(best), None, partners)]
            most = len(best[0][0])
    yield cell.table(*_chosen(cell, _joined(best), None, partners))


def _pairs(cell: _Cell, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both tickers of the pairs of a tile, the first by name first, and their correlation."""
    wanted = cell.wanted(rows, columns)
    i, j = np.nonzero(wanted)
    correlation = _pearson_all(cell.values[rows], cell.values[columns], wanted)[i, j]
    return *cell.named(rows[i], columns[j]), correlation


def _in_order(cell: _Cell, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of a stretch by rising correlation, unknown ones first, a tile's number at a time.

    Equal values then follow each other once they are rounded, and a column file has to keep each but once:
    the values are nearly all of a table of pairs, and in the order of the tickers nothing shortens them.
    One number has the first bits of the value and the place of the pair, so that sorting needs no further array.
    """
    value, keys = np.empty((len(rows), len(columns))), [np.zeros(0, np.int64)]
    for i, j in cell.places(rows, columns):
        found, wanted = value[i, j], cell.wanted(rows[i], columns[j])
        found[:] = _pearson_all(cell.values[rows[i]], cell.values[columns[j]], wanted)
        x, y = np.nonzero(wanted)
        # No correlation is outside of -2 and 2, however it is rounded.
        rank = np.nan_to_num((found[x, y] + 2) * 2.0**24, nan=0.0).astype(np.int64)
        keys.append((rank << _POSITION) | ((x + i.start) * len(columns) + y + j.start))
    key = np.concatenate(keys)
    del keys
    key.sort()
    for start in range(0, len(key), _TILE[0] * _TILE[1]):
        place = key[start : start + _TILE[0] * _TILE[1]] & (2**_POSITION - 1)
        x, y = np.divmod(place, len(columns))
        yield *cell.named(rows[x], columns[y]), value.reshape(-1)[place]


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _chosen(cell: _Cell, pairs: tuple[np.ndarray, ...], top: int | None, partners: int | None) -> tuple[np.ndarray, ...]:
    a, b, value = pairs
    kept = _best(cell.order[a], cell.order[b], value, top, partners)
    return a[kept], b[kept], value[kept]


def _top(cell: _Cell, top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` best pairs of a cell.

    Once so many are known, a pair is computed only where :class:`_Screen` does not rule it out.
    """
    best, screen, tiles = _pairs(cell, cell.lefts[:0], cell.rights[:0]), None, list(cell.tiles())
    for rows, columns in tiles:
        least = best[2][-1] if top and len(best[2]) == top else np.nan
        if not least > 0:
            found = _pairs(cell, rows, columns)
            if len(tiles) > 1:
                found = _anew(cell, found, top)
        else:
            screen = screen or _Screen(cell.values)
            found = _computed(cell, *screen.above(least, rows, columns))
        best = _chosen(cell, _joined([best, found]), top, None)
    return best


def _anew(cell: _Cell, pairs: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """The pairs that may be among the ``top`` best, computed as those of other tiles are, so that equal histories tie."""
    least = _chosen(cell, pairs, top, None)[2][-1:]
    out = (pairs[2] < least - 1e-9) | (np.isnan(pairs[2]) & ~np.isnan(least)) if len(pairs[2]) > top > 0 else np.zeros(len(pairs[2]), bool)
    a, b = (x[~out] for x in pairs[:2])
    return a, b, _pearson_pairs(cell.values, a, b)


def _computed(cell: _Cell, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Those of some pairs that are wanted, and their correlation."""
    wanted = cell.wants(left, right)
    a, b = cell.named(left[wanted], right[wanted])
    return a, b, _pearson_pairs(cell.values, a, b)


class _Screen:
    """Which pairs may reach a correlation, by sums in single precision; none that does is left out.

    Series are centred and have length 1, so that no sum of products exceeds 1.  All rounding together
    stays below ``slack``; a further column of the matrices adds it to what is to be large, and takes it
    off what is to be small.
    """

    def __init__(self, values: np.ndarray):
        known = ~np.isnan(values)
        n = np.maximum(known.sum(axis=1, keepdims=True), 1)
        dv = np.where(known, values - np.where(known, values, 0.0).sum(axis=1, keepdims=True) / n, 0.0)
        length = np.sqrt((dv * dv).sum(axis=1, keepdims=True))
        # Too little spread for its size, or none: nothing is ruled out by its sums.
        plain = length > 1e-6 * np.abs(np.where(known, values, 0.0)).max(axis=1, keepdims=True)
        unit = np.where(plain, dv / np.where(plain, length, 1.0), 0.0)
        slack = 8 * (values.shape[1] + 8) * 2.0**-24

        def widened(v: np.ndarray, last: float) -> np.ndarray:
            return np.c_[v, np.full(len(v), last)].astype(np.float32)

        self.known, self.unit = widened(known, 0), widened(unit, 0)
        self.shared, self.square, self.taken = widened(unit, slack**0.5), widened(unit * unit, -slack), widened(known, 1)
        low, high = np.where(known, values, np.inf).min(axis=1), np.where(known, values, -np.inf).max(axis=1)
        self.varies = high > low  # a constant has no correlation with any

    def above(self, least: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of two common values or more that may have a correlation of ``least``, which is positive, or above."""
        rows, columns = rows[self.varies[rows]], columns[self.varies[columns]]
        x_known, y_known = self.known[rows], self.known[columns].T
        # All sums are taken times the number of common values, so that nothing is divided.
        n, sum_x, sum_y = x_known @ y_known, self.unit[rows] @ y_known, x_known @ self.unit[columns].T
        spread_x, spread_y = self.square[rows] @ self.taken[columns].T, self.taken[rows] @ self.square[columns].T
        shared = self.shared[rows] @ self.shared[columns].T
        for product in (shared, spread_x, spread_y):
            product *= n
        shared -= sum_x * sum_y
        for spread, sums in ((spread_x, sum_x), (spread_y, sum_y)):
            sums *= sums
            spread -= sums
            np.maximum(spread, 0, out=spread)
        spread_x *= spread_y
        np.sqrt(spread_x, out=spread_x)
        spread_x *= np.float32(least * (1 - 1e-6))
        at = np.flatnonzero(shared >= spread_x)
        i, j = np.divmod(at[n.reshape(-1)[at] > 1], max(len(columns), 1))
        return rows[i], columns[j]


class _Cell:
    """A cell: the names of its rows, their order by name, the rows of both sides, and the matrices."""

    def __init__(self, table: pa.Table):
        self.names = table["ticker"].combine_chunks()
        left = table["left"].to_numpy()
        self.mirrored = table["mirrored"].to_numpy()
        self.order = np.unique(np.asarray(self.names.to_pylist(), dtype=object), return_inverse=True)[1]
        by_name = np.argsort(self.order, kind="stable")
        self.lefts, self.rights = by_name[left[by_name]], by_name[~left[by_name]]
        self.present, self.values = _matrix(table)

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the left and the right side, so many together that their pairs are held at once."""
        for i, j in self.places(self.lefts, self.rights):
            yield self.lefts[i], self.rights[j]

    def stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the left and the right side, so many together that their pairs are put into order together."""
        across = math.ceil(len(self.rights) * _TILE[0] / _SORTED)
        down = math.ceil(len(self.lefts) * len(self.rights) / max(across, 1) / _SORTED)
        for rows in np.array_split(self.lefts, max(down, 1)):
            for columns in np.array_split(self.rights, max(across, 1)):
                yield rows, columns

    def places(self, lefts: np.ndarray, rights: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """Where the tiles of some rows of the left and the right side are among them."""
        for i in range(0, len(lefts), _TILE[0]):
            rows = lefts[i : i + _TILE[0]]
            for j in range(0, len(rights), _TILE[1]):
                columns = rights[j : j + _TILE[1]]
                # Below the diagonal of a block with itself the pairs are those above it.
                if not self.mirrored[columns].all() or self.order[rows[0]] < self.order[columns[-1]]:
                    yield slice(i, i + len(rows)), slice(j, j + len(columns))

    def wanted(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        a, b = self.order[rows][:, None], self.order[columns]
        wanted = (a < b) | ((a > b) & ~self.mirrored[columns])
        return wanted & (_counted(self.present[rows], self.present[columns]) > 0)

    def wants(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same of single pairs, which are known to share a date."""
        a, b = self.order[left], self.order[right]
        return (a < b) | ((a > b) & ~self.mirrored[right])

    def named(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with the first by name first."""
        swapped = self.order[left] > self.order[right]
        return np.where(swapped, right, left), np.where(swapped, left, right)

    def table(self, a: np.ndarray, b: np.ndarray, correlation: np.ndarray) -> pa.Table:
        return pa.table(
            {
                "ticker_a": self.names.take(pa.array(a)),
                "ticker_b": self.names.take(pa.array(b)),
                "correlation": pa.array(correlation, mask=np.isnan(correlation)),
            }
        )


def _counted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.float32) @ b.astype(np.float32).T


def moments_of_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and exact sums of a cell's pairs; the first ticker of a pair is the first by name."""
    cell = _Cell(pa.Table.from_batches(list(batches)))
    known = ~np.isnan(cell.values)
    whole = np.rint(np.where(known, cell.values, 0.0) * 1e4)
    if whole.size and np.abs(whole).max() >= 2.0 ** (2 * _LIMB):
        raise ValueError("a return of 100 million percent or more")
    for rows, columns in cell.tiles():
        yield from _moments(cell, known, whole, rows, columns).combine_chunks().to_batches()


def _moments(cell: _Cell, known: np.ndarray, whole: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> pa.Table:
    i, j = np.nonzero(cell.wanted(rows, columns))
    swapped = cell.order[rows[i]] > cell.order[columns[j]]
    x, y = _limbs(whole[rows]), _limbs(whole[columns])
    one_x, one_y = [known[rows].astype(float)], [known[columns].astype(float)]
    sums = {
        "a": _exact(x, one_y, i, j),
        "b": _exact(one_x, y, i, j),
        "aa": _exact_squares(x, one_y, i, j),
        "bb": _exact_squares(y, one_x, j, i),
        "ab": _exact(x, y, i, j),
    }
    sums = {name: _carried(total) for name, total in sums.items()}
    for one, other in (("a", "b"), ("aa", "bb")):
        first, second = sums[one], sums[other]
        sums[one], sums[other] = np.where(swapped, second, first), np.where(swapped, first, second)
    a, b = cell.named(rows[i], columns[j])
    return pa.table(
        {
            "ticker_a": cell.names.take(pa.array(a)),
            "ticker_b": cell.names.take(pa.array(b)),
            "shared": pa.array(_counted(cell.present[rows], cell.present[columns])[i, j].astype(np.int64)),
            "n": pa.array(_exact(one_x, one_y, i, j)[0]),
            **{f"sum_{k}": _longs(sums[k]) for k in ("a", "b")},
            **{f"sum_{k}": _decimals(sums[k]) for k in ("aa", "bb", "ab")},
        }
    )


_LIMB = 20  # bits; products of two limbs over _DATES dates are whole numbers of 53 bits
_DATES = 2**13


def _limbs(whole: np.ndarray) -> list[np.ndarray]:
    """Numbers as sums of limbs times powers of 2**20; the last limb has the sign."""
    found = []
    while whole.size and np.abs(whole).max() >= 2.0**_LIMB:
        high = np.floor(whole / 2.0**_LIMB)
        found.append(whole - high * 2.0**_LIMB)
        whole = high
    return [*found, whole]


def _exact(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Sums over the dates of the products of rows ``i`` of ``x`` and ``j`` of ``y``: one for each power of 2**20."""
    total = [np.zeros(len(i), np.int64) for _ in range(len(x) + len(y) - 1)]
    for p, a in enumerate(x):
        for q, b in enumerate(y):
            for start in range(0, a.shape[1], _DATES):
                total[p + q] += (a[:, start : start + _DATES] @ b[:, start : start + _DATES].T)[i, j].astype(np.int64)
    return total


def _exact_squares(x: list[np.ndarray], known: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The same of the squares of ``x`` where the other has a value."""
    total = [np.zeros(len(i), np.int64) for _ in range(2 * len(x) - 1)]
    for p, a in enumerate(x):
        for q, b in enumerate(x):
            total[p + q] += _exact([a * b], known, i, j)[0]
    return total


def _carried(total: list[np.ndarray]) -> np.ndarray:
    """Sums by powers of 2**20 as a multiple of 2**40, which has the sign, and what is left of it."""
    low, middle, *high = [*total, *(np.zeros_like(total[0]) for _ in range(3 - len(total)))]
    middle = middle + (low >> _LIMB)
    # What is lost above 64 bits is lost in all of them: the sum itself has less.
    multiple = sum((part << (_LIMB * k) for k, part in enumerate(high)), middle >> _LIMB)
    return np.stack([multiple, ((middle & 2**_LIMB - 1) << _LIMB) | (low & 2**_LIMB - 1)])


def _longs(sums: np.ndarray) -> pa.Array:
    return pa.array((sums[0] << (2 * _LIMB)) | sums[1])


def _decimals(sums: np.ndarray) -> pa.Array:
    """Whole numbers of 128 bits, from what :func:`_carried` gives."""
    multiple, rest = sums
    words = np.empty((len(rest), 2), "<i8")
    words[:, 0], words[:, 1] = (multiple << (2 * _LIMB)) | rest, multiple >> (64 - 2 * _LIMB)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(rest), [None, pa.py_buffer(words)])


def _best(a: np.ndarray, b: np.ndarray, value: np.ndarray, top: int | None, partners: int | None) -> np.ndarray:
    """Which pairs are wanted; unknown values come last, and ties go by the tickers."""
    falling = np.where(np.isnan(value), np.inf, -value)
    if top is not None:
        return np.lexsort((b, a, falling))[:top]
    if partners is None:
        return np.arange(len(value))
    ticker, partner = np.r_[a, b], np.r_[b, a]
    by_rank = np.lexsort((partner, np.r_[falling, falling], ticker))
    first = np.flatnonzero(np.r_[True, np.diff(ticker[by_rank]) != 0][: len(by_rank)])
    rank = np.arange(len(by_rank)) - np.repeat(first, np.diff(np.r_[first, len(by_rank)]))
    return np.unique(by_rank[rank < partners] % max(len(value), 1))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table against the dates of the cell: is there a bar, and its return."""
    days = table["days"].combine_chunks()
    row = np.repeat(np.arange(len(days)), days.value_lengths().to_numpy())
    dates, column = np.unique(days.flatten().to_numpy(), return_inverse=True)
    present = np.zeros((len(days), len(dates)), bool)
    values = np.full(present.shape, np.nan)
    present[row, column] = True
    # Of repeated bars the largest return counts, in whatever order they come.
    np.fmax.at(values, (row, column), table["values"].combine_chunks().flatten().to_numpy())
    return present, values


def _pearson_all(x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Correlation of every row of ``x`` with every row of ``y`` over their common values.

    Sums over the common values of all pairs are matrix products.  Where they cancel,
    as for a series that is constant on the common dates, the pair is computed
    from its values.
    """

    def prepared(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(v)
        mean = np.where(known, v, 0.0).sum(axis=1, keepdims=True) / np.maximum(known.sum(axis=1, keepdims=True), 1)
        return known.astype(float), np.where(known, v - mean, 0.0)

    (x_known, dx), (y_known, dy) = prepared(x), prepared(y)
    n = np.maximum(x_known @ y_known.T, 1)
    sum_x, sum_y = dx @ y_known.T, x_known @ dy.T
    square_x, square_y = (dx * dx) @ y_known.T, x_known @ (dy * dy).T
    spread_x, spread_y = square_x - sum_x * sum_x / n, square_y - sum_y * sum_y / n
    cancelled = (spread_x <= _CANCELLED * square_x) | (spread_y <= _CANCELLED * square_y)
    shared = dx @ dy.T - sum_x * sum_y / n
    result = np.full(n.shape, np.nan)
    np.divide(shared, np.sqrt(np.where(cancelled, 1.0, spread_x * spread_y)), out=result, where=~cancelled)
    for row in np.flatnonzero((cancelled & wanted).any(axis=1)):
        columns = np.flatnonzero(cancelled[row] & wanted[row])
        result[row, columns] = _pearson(x[row], y[columns])
    return result


def _pearson_pairs(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of the rows ``a`` with the rows ``b``, one by one, some at a time."""
    parts = [slice(k, k + _AT_ONCE) for k in range(0, len(a), _AT_ONCE)]
    return np.concatenate([np.zeros(0), *(_pearson(values[a[p]], values[b[p]]) for p in parts)])


def _pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of one series, or of each row of ``x``, with each row of ``y`` over their common values.

    A constant is recognised by its extremes, since its computed spread need not be
    exactly zero.
    """
    common = ~np.isnan(x) & ~np.isnan(y)
    n = np.maximum(common.sum(axis=1, keepdims=True), 1)

    def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.broadcast_to(v, common.shape)
        varies = np.max(v, axis=1, where=common, initial=-np.inf) > np.min(v, axis=1, where=common, initial=np.inf)
        known = np.where(common, v, 0.0)
        return np.where(common, known - known.sum(axis=1, keepdims=True) / n, 0.0), varies

    dx, x_varies = centred(x)
    dy, y_varies = centred(y)
    spread = np.sqrt((dx * dx).sum(axis=1)) * np.sqrt((dy * dy).sum(axis=1))
    result = np.full(len(y), np.nan)
    np.divide((dx * dy).sum(axis=1), spread, out=result, where=x_varies & y_varies & (spread > 0))
    return result
