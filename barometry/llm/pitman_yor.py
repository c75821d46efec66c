"""Text probabilities by a hierarchical Pitman-Yor model, and by a smoothed unigram.

Dishes are words, and a restaurant is a context: the word before, for the first word of a
text the end of a text.  All contexts share one parent, the restaurant of all words, which
draws from the known words and one unknown word alike.  A table of a context is one
customer of the parent.  Restaurants are keyed by 48 bits of the hash of their word, so
that there are as many as words, and they grow with the corpus.

Seating is sampled by Gibbs: a sweep takes every customer of every dish of every context
out once, in random order, and draws its table given the others; tables that close or open
take their customer from the parent's tables, or seat it there, and the parent's customers
are redrawn alike.  One rule holds at every count, and tables are carried from sweep to
sweep and from round to round.  A dish with one customer has one table and needs no drawing.
Work is spread as usual for such samplers: a sweep goes in steps, each of which takes one
customer out of each dish, and one more for every 64 that sit there, and draws them given the
others as the step found them; the parent's tables follow whenever half of the dishes are
done, and within a round a task sees those changes of a restaurant that are its own.

A task has some of the words with all their contexts.  The tables of a restaurant lie with
many tasks: after each round, tasks send what they have beyond one table a dish to the
task that has the word of the context, summed per task and context, and get totals back.

Texts meet the model in cells of consecutive rows.  A cell names each of its pairs (word
before, word) once and gets back the counts of the words and of the pairs, and how many
tables they have in the rounds that are kept; predictive probabilities are averaged over those.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    cell_rows,
    compressed,
    groups,
    lower_bytes,
    packed_cells,
    parts_for,
    remainder,
    restored,
    temporary,
    word_hashes,
    written,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLD, HELD_OUT = 10, 0
DISCOUNTS = (0.6, 0.8)  # of all words, of a context
STRENGTH = 1.0
BURN_IN, KEPT, SWEEPS = 2, 2, 1  # rounds that are left out and kept, sweeps in each
_SHARE = 64  # of so many customers of a dish one more is out at once
PARTS, _PART = 256, 2**27  # into which the words are dealt by their hash, and bytes of text from which on there are more
_CELL = 2**13, 2**25  # rows and bytes after which a cell ends
_AT_ONCE = 2**15  # bytes of text from which on words are hashed
_END = np.uint64(0x5851F42D4C957F2D)  # the token that ends a text, and the context of the next one's first word
_PAIRS, _TOTALS, _WORDS, _STATE = -4, -3, -2, -1  # in the column of cells, before the cells of a part
_ROW = "part int, cell bigint, data binary"


# Packing --------------------------------------------------------------------


def _bytes(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers as planes: all lowest bytes, then the next ones; the empty ones compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    result = np.zeros((planes.shape[1], 8), np.uint8)
    result[:, :width] = planes.T
    return result.reshape(-1).view(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    return compressed(*(_bytes(x) for x in columns))


def _unpacked(data: bytes) -> list[np.ndarray]:
    return [_numbers(x) for x in restored(data)]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Those of numbers in order that differ from the one before."""
    return x[_changes(x)]


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each number differs from the one before; the first one does."""
    result = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=result[1:])
    return result


def _sums(x: np.ndarray) -> np.ndarray:
    """The sum of no number, of the first one, of the first two, and so on."""
    result = np.zeros(len(x) + 1, x.dtype)
    x.cumsum(out=result[1:])
    return result


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and which of them each is."""
    found = pa.array(x).dictionary_encode()
    known = found.dictionary.to_numpy()
    order = known.argsort()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return known[order], rank[found.indices.to_numpy()]


def _numbered_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs ``x << 32 | y`` in order, and which of them each is; ``x`` and ``y`` are small whole numbers."""
    low, place = (int(z).bit_length() for z in (y.max(initial=0), len(y)))
    if int(x.max(initial=0)).bit_length() + low + place > 63:
        return _numbered(x << 32 | y)
    # With their places behind them the numbers are sorted as they are.
    order = np.sort((x << low | y) << place | np.arange(len(x)))
    pair = order >> place
    first = _changes(pair)
    order &= (1 << place) - 1
    number = np.empty(len(x), np.int64)
    number[order] = first.cumsum() - 1
    pair = pair[first]
    return pair >> low << 32 | pair & ((1 << low) - 1), number


def _contexts(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(16)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    kinds = pa.int32(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "cell", "data"])


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "cell")


def _part_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    for table in groups(batches, 1):
        yield table["part"][0].as_py(), list(zip(table["cell"].to_pylist(), table["data"].to_pylist(), strict=True))


# Pairs of cells and parts ---------------------------------------------------


def cell_pairs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct words and pairs of texts, and which each token is.

    Returns the distinct words in order, for each pair its word and its context (numbers of
    words; in order), for each token its word and its pair, and the tokens of each text.
    """
    every, lengths = _tokens(texts)
    words, word = _numbered(every)
    end = np.searchsorted(words, _END)
    pairs, pair = _numbered_pairs(word, np.append(end, word[:-1]))
    return words, pairs >> 32, pairs & 0xFFFFFFFF, word, pair, lengths


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of each text with its end, text after text, and how many each has."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(texts):
        # Many texts go through the hashes at once, but no more than fit the caches.
        end, size = at, 0
        while end < len(texts) and size < _AT_ONCE:
            size, end = size + len(texts[end]) + 1, end + 1
        found, begins = word_hashes(lower_bytes(b" ".join(texts[at:end])), places=True)
        bounds = _sums(np.array([len(text) + 1 for text in texts[at:end]]))
        hashes.append(found)
        counts.append(np.diff(begins.searchsorted(bounds)))
        at = end
    lengths = np.concatenate(counts) + 1
    every = np.empty(lengths.sum(), np.uint64)
    is_word = np.ones(len(every), bool)
    is_word[lengths.cumsum() - 1] = False
    every[is_word], every[~is_word] = np.concatenate(hashes), _END
    return every, lengths


def _asked(parts: int):
    bits = np.uint64(64 - (parts - 1).bit_length())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, data in ((c.as_py(), d.as_py()) for b in batches for c, d in zip(*b.columns, strict=True)):
            _, _, held_out, texts = cell_rows(data)
            words, own, context, _, pair, lengths = cell_pairs(texts)
            counts = np.bincount(pair, np.repeat(~held_out, lengths), len(own)).astype(np.int64)
            contexts, sizes = _contexts(words)[context], np.bincount(own, minlength=len(words))
            part = (words >> bits).astype(np.int64) if parts > 1 else np.zeros(len(words), np.int64)
            word_at = np.searchsorted(part, np.arange(parts + 1))
            pair_at = np.searchsorted(own, word_at)
            rows = []
            for p in np.flatnonzero(np.diff(word_at)):
                w, x = slice(*word_at[p : p + 2]), slice(*pair_at[p : p + 2])
                rows.append((int(p), cell, compressed(words[w], _bytes(sizes[w]), _bytes(contexts[x], 6), _bytes(counts[x]))))
            yield _batch(rows)

    return run


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a part over all cells, and the asked ones of each cell as their numbers."""
    for part, asks in _part_groups(batches):
        words, contexts, counts, lengths = [], [], [], []
        for _, data in asks:
            own, sizes, context, count = restored(data)
            words.append(np.repeat(np.frombuffer(own, np.uint64), _numbers(sizes)))
            contexts.append(_numbers(context, 6))
            counts.append(_numbers(count))
            lengths.append(len(contexts[-1]))
        words, contexts, counts = map(np.concatenate, (words, contexts, counts))
        order = np.lexsort((contexts, words))
        words, contexts = words[order], contexts[order]
        first = _changes(words) | _changes(contexts)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        counts = np.bincount(number, counts).astype(np.int64)
        known, sizes = np.unique(words[first], return_counts=True)
        yield _batch([(part, _PAIRS, _packed(sizes, contexts[first], counts))])
        yield _batch([(part, _WORDS, _packed(sizes, _contexts(known), counts))])
        steps = _sums(np.array(lengths))
        for (cell, _), a, b in zip(asks, steps[:-1], steps[1:], strict=True):
            own = number[a:b].copy()
            own[1:] -= number[a : b - 1]
            yield _batch([(part, cell, _packed(own))])


def _model(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of pairs or of words: the number of words, their pairs' words, the contexts (or the words' own), and the pairs' counts."""
    sizes, contexts, counts = _unpacked(data)
    return len(sizes), np.repeat(np.arange(len(sizes)), sizes), contexts, counts


# Seating --------------------------------------------------------------------


class Seating:
    """Table sizes of many dishes: ``sizes``, dish after dish, each of which has so many ``tables``."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.n, self._tables, self.sizes = len(tables), tables.astype(np.int64), sizes

    @classmethod
    def start(cls, customers: np.ndarray) -> Seating:
        """Any seating will do to begin with: half of the customers at one table, half of the rest at the next."""
        rest, sizes, dishes = customers.copy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while rest.any():
            rows = np.flatnonzero(rest)
            dishes.append(rows)
            sizes.append((rest[rows] + 1) // 2)
            rest[rows] -= sizes[-1]
        dish = np.concatenate(dishes)
        return cls(np.bincount(dish, minlength=len(customers)), np.concatenate(sizes)[np.argsort(dish, kind="stable")])

    @property
    def dish(self) -> np.ndarray:
        """The dish of each table."""
        return np.repeat(np.arange(self.n), self._tables)

    def customers(self) -> np.ndarray:
        ends = _sums(self.sizes)[_sums(self._tables)]
        return ends[1:] - ends[:-1]

    def tables(self) -> np.ndarray:
        return self._tables.copy()

    def _inside(self, rows: np.ndarray) -> np.ndarray:
        member = np.zeros(self.n, bool)
        member[rows] = True
        return member.repeat(self._tables)

    def taken(self, rows: np.ndarray) -> Seating:
        """The dishes ``rows`` alone."""
        return Seating(self._tables[rows], self.sizes[self._inside(rows)])

    def put(self, rows: np.ndarray, part: Seating) -> None:
        """The dishes ``rows`` as they are in ``part``."""
        others = self.sizes[~self._inside(rows)]
        self._tables[rows] = part._tables
        inside = self._inside(rows)
        self.sizes = np.empty(len(inside), np.int64)
        self.sizes[inside], self.sizes[~inside] = part.sizes, others

    def leave(self, take: np.ndarray, rng: np.random.Generator, left: np.ndarray | None = None):
        """Takes customers out of the dishes, ``take`` of each, any with the same chance.

        ``left`` says how many of each table may go, by default all; those drawn twice go once.
        Returns the dish of each that went, how many tables closed in each dish, and what is ``left``.
        """
        own = self.sizes if left is None else left
        sums, last = _sums(own), self._tables.cumsum()
        ends, low = sums[1:], sums[last - self._tables]
        size = sums[last] - low
        take = np.minimum(take, size)
        row = np.arange(self.n).repeat(take)
        place = low[row] + (rng.random(len(row)) * size[row]).astype(np.int64)
        several = len(row) > np.count_nonzero(take)
        if several:
            every = np.arange(len(row)) + (low - take.cumsum() + take)[row]
            place = np.where((take == size)[row], every, place)
            place.sort()
            place = _distinct(place)
        at = ends.searchsorted(place, "right")
        if several:
            row = last.searchsorted(at, "right")
        out = np.bincount(at, minlength=len(own))
        self.sizes = self.sizes - out
        left = None if left is None else left - out
        empty = self.sizes[at] == 0
        shut = _distinct(at[empty])
        if not len(shut):
            closed = np.zeros(self.n, np.int64)
        else:
            closed = np.bincount(last.searchsorted(shut, "right"), minlength=self.n)
            kept = np.ones(len(self.sizes), bool)
            kept[shut] = False
            self.sizes, self._tables = self.sizes[kept], self._tables - closed
            left = None if left is None else left[kept]
        return row, closed, left

    def enter(self, row: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator, left=None):
        """Draws tables for customers of the dishes ``row`` (in order) given those that sit there.

        ``opening`` is the weight of a new table, of each dish: (strength + discount * tables of the
        restaurant) times the parent's probability of the dish.  Returns how many tables
        opened in each dish, and what is ``left`` (of a new table, nobody).
        """
        ends, after = _sums(self.sizes - discount), self._tables.cumsum()
        before = after - self._tables
        start = ends[before]
        weight = ends[after] - start
        draw = rng.random(len(row)) * (weight + opening)[row]
        new = (draw >= weight[row]) | (self._tables == 0)[row]
        seated = ~new
        old, fresh = row[seated], row[new]
        at = ends.searchsorted(start[old] + draw[seated], "right") - 1
        at = np.minimum(np.maximum(at, before[old]), after[old] - 1)
        self.sizes = self.sizes + np.bincount(at, minlength=len(self.sizes))
        opened = np.bincount(fresh, minlength=self.n)
        if len(fresh):
            others = np.ones(len(self.sizes) + len(fresh), bool)
            others[after[fresh] + np.arange(len(fresh))] = False  # behind the other tables of the dish
            sizes = np.ones(len(others), np.int64)
            sizes[others] = self.sizes
            self.sizes, self._tables = sizes, self._tables + opened
            if left is not None:
                sizes = np.zeros(len(others), np.int64)
                sizes[others] = left
                left = sizes
        return opened, left

    def remove(self, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Takes one customer out of each of the dishes ``rows``; whether a table closed."""
        return self.leave(np.bincount(rows, minlength=self.n), rng)[1][rows] > 0

    def add(self, rows: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """Seats one customer of each of the dishes ``rows``, which are in order; whether a table opened."""
        weights = np.zeros(self.n)
        weights[rows] = opening
        return self.enter(rows, weights, discount, rng)[0][rows] > 0

    def redraw(self, discount: float, opening, moved, rest, rng: np.random.Generator, once: bool = False) -> None:
        """A sweep: takes every customer out once and draws its table given the others.

        A step takes one customer out of each dish, and one more for every ``_SHARE`` that sit
        there, in random order.  ``opening(rows, closed)`` gives the weights of a new table of the
        dishes ``rows``, less the tables that have closed, ``moved(rows, change)`` hears how many more
        they have after a step, and ``rest()`` is called as half of the dishes are done.  If ``once``,
        only the first customer of each dish is drawn.
        """
        count = self.customers()
        rows, alone = np.flatnonzero(count > 1), np.flatnonzero(count <= 1)
        done, part = [(alone, self.taken(alone))], self.taken(rows)
        left, count = part.sizes.copy(), count[rows]
        waiting = count.copy()
        while len(rows):
            take = np.where(waiting > 0, 1 if once else count // _SHARE + 1, 0)
            row, closed, left = part.leave(take, rng, left)
            waiting -= np.bincount(row, minlength=len(rows))
            opened, left = part.enter(row, opening(rows, closed), discount, rng, left)
            moved(rows, opened - closed)
            over = (waiting == 0) | once
            if 2 * np.count_nonzero(over) >= len(rows):
                done.append((rows[over], part.taken(np.flatnonzero(over))))
                on = np.flatnonzero(~over)
                left, part = left[part._inside(on)], part.taken(on)
                rows, count, waiting = rows[on], count[on], waiting[on]
                rest()
        dish = np.concatenate([np.repeat(rows, part._tables) for rows, part in done])
        self.sizes = np.concatenate([part.sizes for _, part in done])[np.argsort(dish, kind="stable")]
        self._tables = np.bincount(dish, minlength=self.n)


class Part:
    """Dishes of one part: ``low`` those of contexts with two customers or more, ``top`` those of all words.

    ``single`` counts the dishes with one customer of each word.  ``kept`` holds, for each
    round that is kept, the tables of ``low`` and the customers and tables of ``top``.
    """

    def __init__(self, word, contexts, single, low: Seating, top: Seating, kept=()):
        self.word, self.contexts, self.single, self.low, self.top = word, contexts, single, low, top
        self.kept = list(kept)

    @cached_property
    def _restaurants(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.contexts, return_inverse=True)

    @property
    def restaurants(self) -> np.ndarray:
        """The contexts of ``low``, in order."""
        return self._restaurants[0]

    @property
    def home(self) -> np.ndarray:
        """The restaurant of each dish of ``low``."""
        return self._restaurants[1]

    @classmethod
    def start(cls, words: int, word: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> Part:
        many = counts > 1
        single = np.bincount(word[counts == 1], minlength=words)
        low = Seating.start(counts[many])
        top = Seating.start(single + np.bincount(word[many], low.tables(), words).astype(np.int64))
        return cls(word[many], contexts[many], single, low, top)

    def packed(self) -> bytes:
        fixed = self.word, self.contexts, self.single, self.low.tables(), self.low.sizes, self.top.tables(), self.top.sizes
        return _packed(*fixed, *(x for sample in self.kept for x in sample))

    @classmethod
    def unpacked(cls, data: bytes) -> Part:
        word, contexts, single, low, sizes, top, top_sizes, *kept = _unpacked(data)
        return cls(word, contexts, single, Seating(low, sizes), Seating(top, top_sizes), zip(*[iter(kept)] * 3, strict=True))

    def extra(self, tables: np.ndarray) -> np.ndarray:
        """Tables beyond one a dish, by restaurant."""
        return np.bincount(self.home, tables - 1, len(self.restaurants)).astype(np.int64)

    def step(self, tables: np.ndarray, root: list[float], rng: np.random.Generator, first: bool = False) -> None:
        """Redraws one customer of every dish; see :meth:`sweep`."""
        self._redraw(tables, root, rng, first, True)

    def sweep(self, tables: np.ndarray, root: list[float], rng: np.random.Generator, first: bool = False) -> None:
        """Redraws every customer of every dish.

        ``tables`` are those of ``restaurants`` over all parts, ``root`` holds the customers and
        tables of the parent and one more than the words that are known; both are kept up to
        date with what is drawn here.  In the ``first`` sweep the parent's seating starts anew.
        """
        self._redraw(tables, root, rng, first, False)

    def _redraw(self, tables: np.ndarray, root: list[float], rng: np.random.Generator, first: bool, once: bool) -> None:
        d0, d1 = DISCOUNTS
        customers, top_tables = self.top.customers(), self.top.tables()

        def opening(rows: np.ndarray, closed: np.ndarray) -> np.ndarray:
            word, home = self.word[rows], self.home[rows]
            left = customers[word] - closed
            parent = np.maximum(left - d0 * np.minimum(top_tables[word], left), 0) + (STRENGTH + d0 * root[1]) / root[2]
            return (STRENGTH + d1 * (tables[home] - closed)) * parent / (STRENGTH + root[0] - closed)

        def moved(rows: np.ndarray, change: np.ndarray) -> None:
            at = np.flatnonzero(change)
            rows, change = rows[at], change[at]
            np.add.at(tables, self.home[rows], change)
            np.add.at(customers, self.word[rows], change)
            root[0] += change.sum()

        def follow() -> None:
            """Tables that have closed and opened take their customers from the parent's tables, or seat them there."""
            if not first:
                self._follow(self.top, customers - self.top.customers(), (STRENGTH + d0 * root[1]) / root[2], rng)
                top_tables[:], root[1] = self.top.tables(), root[1] + len(self.top.sizes) - top_tables.sum()

        def top_opening(rows: np.ndarray, closed: np.ndarray) -> np.ndarray:
            return (STRENGTH + d0 * (root[1] - closed)) / root[2]

        def top_moved(_: np.ndarray, change: np.ndarray) -> None:
            root[1] += change.sum()

        self.low.redraw(d1, opening, moved, follow, rng, once)
        if first:
            self.top = Seating.start(customers)
            root[1] += len(self.top.sizes) - top_tables.sum()
        self.top.redraw(d0, top_opening, top_moved, lambda: None, rng, once)

    @classmethod
    def _follow(cls, seating: Seating, change: np.ndarray, opening: float, rng: np.random.Generator) -> None:
        """Customers of the parent go and come, as tables have closed and opened, as many at once as in a step of a sweep."""
        while len(rows := np.flatnonzero(change)):
            if 2 * len(rows) <= seating.n:  # most dishes are done: go on with the others alone
                part = seating.taken(rows)
                cls._follow(part, change[rows], opening, rng)
                seating.put(rows, part)
                return
            most = seating.customers() // _SHARE + 1
            gone = np.bincount(seating.leave(np.clip(-change, 0, most), rng)[0], minlength=seating.n)
            come = np.clip(change, 0, most)
            seating.enter(np.repeat(np.arange(seating.n), come), np.full(seating.n, opening), DISCOUNTS[0], rng)
            change = change + gone - come


# Rounds ---------------------------------------------------------------------


def _dealt(part: int, contexts: np.ndarray, parts: int, *columns: np.ndarray) -> list[tuple]:
    """One row for each part that has some of the ``contexts`` (in order) as its words."""
    bounds = np.searchsorted(contexts >> (48 - (parts - 1).bit_length()), np.arange(parts + 1))
    return [
        (int(q), part, _packed(contexts[a:b], *(x[a:b] for x in columns)))
        for q, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
        if b > a
    ]


def _dishes(parts: int):
    """How many dishes restaurants have in a part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, contexts, counts = _model(data)
                known, dishes = np.unique(contexts[counts > 0], return_counts=True)
                yield _batch(_dealt(part, known, parts, dishes))

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _part_groups(batches):
        contexts, counts = (np.concatenate(x) for x in zip(*(_unpacked(data) for _, data in rows), strict=True))
        known, place = np.unique(contexts, return_inverse=True)
        yield _batch([(part, _TOTALS, _packed(known, np.bincount(place, counts).astype(np.int64)))])


def _started(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _state(part, Part.start(*_model(data)))


def _state(number: int, part: Part) -> pa.RecordBatch:
    batch = _batch([(number, _STATE, part.packed())])
    for name, value in (("customers", part.top.sizes.sum()), ("tables", len(part.top.sizes))):
        batch = batch.append_column(name, pa.array([int(value)], pa.int64()))
    return batch


_STATE_ROW = f"{_ROW}, customers bigint, tables bigint"


def _extras(parts: int, kept: bool):
    """Tables of a part beyond one a dish, by restaurant: now, or in each round that is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                part = Part.unpacked(data)
                samples = [x[0] for x in part.kept] if kept else [part.low.tables()]
                yield _batch(_dealt(number, part.restaurants, parts, *map(part.extra, samples)))

    return run


def _tables(rows: list[tuple[int, bytes]], samples: int) -> tuple[np.ndarray, list[np.ndarray], list]:
    """Restaurants of a part, their tables in each sample, and which of them are those of each other part."""
    known, dishes = _unpacked(rows[0][1])
    sums, places = [dishes.copy() for _ in range(samples)], []
    for source, data in rows[1:]:
        contexts, *extras = _unpacked(data)
        at = known.searchsorted(contexts)
        places.append((source, at))
        for total, extra in zip(sums, extras, strict=True):
            total[at] += extra
    return known, sums, places


def _replies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _part_groups(batches):
        _, (total,), places = _tables(rows, 1)
        yield _batch([(source, part, _packed(total[at])) for source, at in places])


def _final(samples: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _part_groups(batches):
            known, sums, _ = _tables(rows, samples)
            yield _batch([(part, _TOTALS, _packed(known, *sums))])

    return run


def _round(number: int, seed: int, root: list[float], keep: bool, sweeps: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _part_groups(batches):
            part, own, rng = Part.unpacked(rows[0][1]), list(root), np.random.default_rng([seed, number, p])
            tables = np.concatenate([np.zeros(0, np.int64), *(_unpacked(data)[0] for _, data in rows[1:])])
            for i in range(sweeps):
                part.sweep(tables, own, rng, number == 0 and i == 0)
            if keep:
                part.kept.append((part.low.tables(), part.top.customers(), part.top.tables()))
            yield _state(p, part)

    return run


# Answers --------------------------------------------------------------------


def _differences(columns: list[np.ndarray], samples: int) -> list[np.ndarray]:
    """What later samples have more or less than the first: small numbers, the negative ones made odd."""
    result = columns[:1]
    for kind in (columns[1 : samples + 1], columns[samples + 1 :: 2], columns[samples + 2 :: 2]):
        later = [x - kind[0] for x in kind[1:]]
        result += [kind[0], *(x << 1 ^ x >> 63 for x in later)]
    return result


def _from_differences(columns: list[np.ndarray], samples: int) -> list[list[np.ndarray]]:
    """Tables as a context, and customers and tables of the parent, in each sample."""
    kinds = [columns[1 + i * samples : 1 + (i + 1) * samples] for i in range(3)]
    return [[kind[0], *(kind[0] + (x >> 1 ^ -(x & 1)) for x in kind[1:])] for kind in kinds]


def _answers(samples: int):
    """For the words that a cell asks for: count, tables as a context, customers and tables of the parent;

    for its pairs: count, and tables in all samples together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        for batch in batches:
            rows = []
            for p, cell, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != number:
                    number, known, sums = p, np.zeros(1, np.int64), [np.zeros(1, np.int64)] * samples
                if cell == _TOTALS:
                    known, *sums = _unpacked(data)
                elif cell == _WORDS:
                    words, word, own, counts = _model(data)
                    total = np.bincount(word, counts, words).astype(np.int64)
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    has = (known[place] == own) & (total > 0)
                    of_word = [total, *(np.where(has, x[place], 0) for x in sums)]
                elif cell == _STATE:
                    kept, seats = Part.unpacked(data).kept, np.minimum(counts, 1) * samples
                    seats[counts > 1] = sum(x[0] for x in kept)
                    of_word += [x for _, customers, tables in kept for x in (customers, tables)]
                else:
                    own = np.cumsum(_unpacked(data)[0])
                    asked = word[own]
                    asked = asked[np.r_[True, asked[1:] != asked[:-1]]]
                    rows.append((p, cell, _packed(*_differences([x[asked] for x in of_word], samples), counts[own], seats[own])))
            yield _batch(rows)

    return run


def _scores(tokens: int, vocabulary: int, roots: list[tuple[int, int]]):
    """Scores of the texts of a cell; the answers to what it asked come first."""
    whole, (d0, d1) = tokens + 0.1 * (vocabulary + 1), DISCOUNTS

    def probabilities(parts: list[bytes], word: np.ndarray, context: np.ndarray):
        columns = [np.concatenate(x) for x in zip(*map(_unpacked, parts), strict=True)]
        total, (count, seats) = columns[0], columns[-2:]
        tables, at_parent, opened_there = _from_differences(columns[:-2], len(roots))
        value = count - d1 / len(roots) * seats
        for i, (customers, opened) in enumerate(roots):
            chance = np.maximum(at_parent[i] - d0 * opened_there[i], 0) + (STRENGTH + d0 * opened) / (vocabulary + 1)
            chance /= STRENGTH + customers
            value += (STRENGTH + d1 * tables[i][context]) * chance[word] / len(roots)
        return total, np.log10(value / (STRENGTH + total[context]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for batch in batches:
            rows = []
            for cell, is_text, data in zip(*(batch.column(n).to_pylist() for n in ("cell", "is_text", "data")), strict=True):
                if cell != number:
                    number, parts = cell, []
                if not is_text:
                    parts.append(data)
                    continue
                ids, has_id, held_out, texts = cell_rows(data)
                _, own, context, word, pair, lengths = cell_pairs(texts)
                total, score = probabilities(parts, own, context)
                starts = np.cumsum(lengths) - lengths
                columns = [np.add.reduceat(x, starts) for x in ((total > 0)[word].astype(np.int64), np.log10((total + 0.1) / whole)[word], score[pair])]
                parts = []
                for i, n in enumerate(lengths.tolist()):
                    head = int(ids[i]) if has_id[i] else None, bool(held_out[i]), n
                    rows.append((*head, int(columns[0][i]), tokens, float(columns[1][i]), float(columns[2][i])))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            values = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], _RESULT)

    return run


_RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            words, word, _, counts = _model(data)
            total = np.bincount(word, counts, words)
            yield pa.record_batch([pa.array([int((total > 0).sum())]), pa.array([int(total.sum())])], ["words", "tokens"])


def score_texts(
    docs: DataFrame,
    seed: int = 11,
    parts: int | None = None,
    burn_in: int = BURN_IN,
    kept: int = KEPT,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """log10 probabilities of all texts, learned from those outside the held-out fold.

    Held out are the rows whose crc32 of the id modulo 10 is 0.  Words stand between white
    space, A-Z in lower case; the end of a text is a token.  A null text is empty and
    consists of its end; a row with a null id is learned from.  Repeated rows are learned
    from and scored each.  All unknown words are one word to the model, as to the unigram.
    An empty table gives no rows.  ``parts`` is a power of two, by default one that grows with
    the texts; ``burn_in`` rounds of ``sweeps`` are left out before ``kept`` (one or more) are
    averaged.  Returns ``doc_id, held_out, n_tokens, n_known`` (tokens that are in the
    training texts), ``train_tokens, base_score`` (smoothed unigram) and ``score`` (the model).
    """
    held_out = F.coalesce(remainder(FOLD) == HELD_OUT, F.lit(False))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out.alias("flag"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = parts or parts_for(texts, _PART, PARTS)
    cells = packed_cells(texts, *_CELL)
    merged = written(_by_part(cells.mapInArrow(_asked(parts), _ROW)).mapInArrow(_merged, _ROW))
    answers, tokens, words, roots = _sampled(merged, seed, parts, burn_in, kept, sweeps)
    asking = cells.select(F.lit(True).alias("is_text"), F.lit(None).cast("int").alias("part"), "cell", "data")
    together = answers.select(F.lit(False).alias("is_text"), "part", "cell", "data").unionByName(asking)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    dealt = together.repartition("cell").sortWithinPartitions("cell", "is_text", "part")
    return dealt.mapInArrow(_scores(tokens, words, roots), schema)


def _root(state: DataFrame) -> tuple[int, int]:
    """Customers and tables of the parent."""
    customers, tables = state.agg(F.sum("customers"), F.sum("tables")).first()
    return customers or 0, tables or 0


def _sampled(merged: DataFrame, seed: int, parts: int, burn_in: int, kept: int, sweeps: int):
    """Answers to the cells, the training tokens, the words, and the parent's customers and tables in the kept rounds."""
    model = merged.where(F.col("cell") == _PAIRS)
    words, tokens = model.mapInArrow(_vocabulary, "words bigint, tokens bigint").agg(F.sum("words"), F.sum("tokens")).first()
    words, tokens = words or 0, tokens or 0
    totals = written(_by_part(model.mapInArrow(_dishes(parts), _ROW)).mapInArrow(_summed, _ROW))
    roots = []
    with temporary(merged.sparkSession) as states:
        state = written(model.mapInArrow(_started, _STATE_ROW))
        for i in range(burn_in + kept):
            roots.append(_root(state))
            came = totals.unionByName(state.mapInArrow(_extras(parts, False), _ROW))
            replies = _by_part(came).mapInArrow(_replies, _ROW)
            seen = _by_part(state.select("part", "cell", "data").unionByName(replies))
            root = [*roots[-1], words + 1]
            state = written(seen.mapInArrow(_round(i, seed, root, i >= burn_in, sweeps), _STATE_ROW))
        roots.append(_root(state))
        states.pop()  # the last one is read below; those of earlier rounds go
    came = totals.unionByName(state.mapInArrow(_extras(parts, True), _ROW))
    final = _by_part(came).mapInArrow(_final(kept), _ROW)
    met = _by_part(merged.where(F.col("cell") != _PAIRS).unionByName(state.select("part", "cell", "data")).unionByName(final))
    return met.mapInArrow(_answers(kept), _ROW), tokens, words, roots[-kept:]
