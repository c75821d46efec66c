"""Repeated strings across documents, by run-length compressed suffix indexes.

Which strings of ``LENGTH`` bytes also start in a document with a smaller id is decided in
three steps, each an exchange between cells (blocks of consecutive rows) and parts.

1. The anchor of a string is the smallest hash of the short strings in it, so that equal
   strings have equal anchors.  Cells name their anchors; those that occur in more than
   one document come back.
2. Consecutive strings with one such anchor make a stretch.  Cells send their distinct
   stretches, with the smallest id that has them, to the parts of their anchors.  A part
   builds a run-length compressed Burrows-Wheeler transform of its stretches, with samples
   at the ends of runs, and streams the matching statistics of all stretches through it:
   strings that match over the whole length are one, and the smallest id of each goes back.
3. Cells mark the strings that have a smaller id than their document, and cut them out.

An anchor with very many stretches is resolved by exact grouping and not by the index: its
strings are sent one by one, by their own hash, and equal ones are merged where they meet.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOBODY, cell_rows, compressed, groups, mixed, packed_cells, parts_for, powers, restored, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 50  # bytes of a string
_GRAM = 20  # bytes of the short strings
_WINDOW = LENGTH - _GRAM + 1  # of them in a string
_SHIFT = np.uint64(16)  # anchors have 48 bits; equal ones by chance only cost time
_HOT = 4000  # distinct stretches, added up over cells, from which on an anchor is split
_CELL = 2**11, 2**23  # rows and bytes after which a cell ends
_PARTS, _PART = 2**8, 2**27  # parts at least, and bytes of text from which on there are more
_SLICE = 2**17
_LEVEL = 4  # of compression: messages are a tenth smaller than at the first
_INDEX = 2**20  # bytes of stretches in one index


# Anchors ------------------------------------------------------------------


def anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of the string that starts at each byte, and sums that give hashes of any stretch."""
    n = len(codes)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    least = mixed((sums[_GRAM:] - sums[:-_GRAM]) * inverse[: n - _GRAM + 1]) >> _SHIFT
    width = 1
    while 2 * width <= _WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _WINDOW - width
    return np.minimum(least[: len(least) - rest], least[rest:]), sums, inverse


def stretches(texts: list[bytes]) -> Iterator[tuple[bytes, *tuple[np.ndarray, ...]]]:
    """Slices of the texts with their stretches: the bytes, and for each stretch its text,
    where the slice's bytes of it start (and where that is in the text), how many strings it has,
    its anchor, and a hash of what it holds.
    """
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - LENGTH + 1, 0), _SLICE):
            piece = text[start : start + _SLICE + LENGTH - 1]
            pieces.append((i, start, piece))
            size += len(piece)
            if size >= _SLICE:
                yield _stretched(pieces)
                pieces, size = [], 0
    if pieces:
        yield _stretched(pieces)


def _stretched(pieces: list[tuple[int, int, bytes]]):
    data = b"".join(piece for *_, piece in pieces)
    least, sums, inverse = anchors(np.frombuffer(data, np.uint8))
    length = np.array([len(piece) for *_, piece in pieces])
    begin = np.cumsum(length) - length
    # Only strings inside of a piece count: one starts where its piece does, and none behind its last string.
    count = length - LENGTH + 1
    fresh = np.empty(len(least) + 1, bool)
    fresh[0] = fresh[-1] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:-1])
    fresh[begin] = fresh[begin + count] = True
    edges = np.flatnonzero(fresh)
    piece = np.searchsorted(begin, edges[:-1], side="right") - 1
    inside = edges[:-1] < (begin + count)[piece]
    starts, size, piece = edges[:-1][inside], np.diff(edges)[inside], piece[inside]
    # A stretch of equal anchors is no longer than a string has anchors.
    parts = -(-size // _WINDOW)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + number * _WINDOW
    size = np.minimum(np.repeat(size, parts) - number * _WINDOW, _WINDOW)
    piece = np.repeat(piece, parts)
    owner = np.array([i for i, *_ in pieces])[piece]
    offset = starts - begin[piece] + np.array([s for _, s, _ in pieces])[piece]
    held = mixed((sums[starts + size + LENGTH - 1] - sums[starts]) * inverse[starts])
    # Smallest hashes are small; mixed again they are even, and so are the parts.
    return data, owner, starts, offset, size, mixed(least[starts]) >> _SHIFT, held


# Cells --------------------------------------------------------------------


def _bytewise(numbers: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes before all second ones: bytes of one place compress well together."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def _steps(rising: np.ndarray) -> bytes:
    return _bytewise(np.diff(rising, prepend=np.uint64(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


_MESSAGE = "part bigint, cell bigint, kind int, data binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    names = ["part", "cell", "kind", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, bounds) if len(part) else ():
        yield int(part[own[0]]), own


def _part_of(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (anchor >> (np.uint64(64) - _SHIFT - np.uint64(bits))).astype(np.int64)


_ANCHORS, _TEXTS, _REPEATED, _STRETCHES, _OWNERS = range(5)


def _named_anchors(bits: int):
    """Anchors of each cell: how many distinct stretches they have, and whether in several rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, data in ((c.as_py(), d.as_py()) for b in batches for c, d in zip(*b.columns, strict=True)):
            values, owners, contents = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, owner, _, _, _, anchor, held in stretches(cell_rows(data)[3]):
                values.append(anchor)
                owners.append(owner)
                contents.append(held)
            value, owner, held = (np.concatenate(x) for x in (values, owners, contents))
            order = np.argsort(value)
            step = np.r_[True, value[order[1:]] != value[order[:-1]], True]
            tied = np.flatnonzero(~(step[:-1] & step[1:])[: len(order)])
            own = order[tied]
            order[tied] = own[np.lexsort((held[own], value[own]))]
            value, owner, held = value[order], owner[order], held[order]
            fresh = np.r_[True, value[1:] != value[:-1]][: len(value)]
            first = np.flatnonzero(fresh)
            count, several = np.zeros(0, np.int64), np.zeros(0, bool)
            if len(first):
                # Copies of a stretch are sent once.
                other = fresh | np.r_[True, held[1:] != held[:-1]]
                count = np.add.reduceat(other.astype(np.int64), first)
                several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            known = value[first]
            rows = []
            for part, own in _by_part(_part_of(known, bits)):
                note = np.minimum(count[own], 2**15 - 1).astype(np.uint16) | (several[own].astype(np.uint16) << np.uint16(15))
                rows.append((part, cell, _ANCHORS, compressed(_steps(known[own]), note, level=_LEVEL)))
            yield _messages(rows)

    return run


def _repeated_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell its anchors that several rows have, and which of them are to be split."""
    for table in groups(batches, 1):
        part, cells = table["part"][0].as_py(), table["cell"].to_pylist()
        found = [restored(blob.as_py()) for blob in table["data"]]
        values = [_risen(steps) for steps, _ in found]
        notes = [np.frombuffer(note, np.uint16) for _, note in found]
        every, note = np.concatenate(values), np.concatenate(notes)
        _, place, times = np.unique(every, return_inverse=True, return_counts=True)
        several = (times > 1) | (np.bincount(place, note >> 15) > 0)
        hot = np.bincount(place, note & 0x7FFF) > _HOT
        bounds = np.cumsum([0, *map(len, values)])
        rows = []
        for cell, value, a, b in zip(cells, values, bounds[:-1], bounds[1:], strict=True):
            own = several[place[a:b]]
            if own.any():
                rows.append((part, cell, _REPEATED, compressed(_steps(value[own]), hot[place[a:b]][own], level=_LEVEL)))
        yield _messages(rows)


class Cell:
    """The texts of a cell, and its stretches with repeated anchors, always in the same order."""

    def __init__(self, table: pa.Table):
        by_kind: dict[int, list[tuple[int, bytes]]] = {}
        for part, kind, data in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True):
            by_kind.setdefault(kind, []).append((part, data.as_py()))
        self.ids, self.known, _, self.texts = cell_rows(by_kind[_TEXTS][0][1])
        found = [restored(blob) for _, blob in sorted(by_kind.get(_REPEATED, []))]
        self.anchors = np.concatenate([np.zeros(0, np.uint64), *(_risen(v) for v, _ in found)])
        self.hot = np.concatenate([np.zeros(0, bool), *(np.frombuffer(h, bool) for _, h in found)])
        self.owners = dict(by_kind.get(_OWNERS, []))

    def repeated(self) -> Iterator[tuple[bytes, int, int, int, np.ndarray]]:
        """Slices with their repeated stretches: contents, texts, offsets, numbers of strings, keys."""
        if not len(self.anchors):
            return
        # Most stretches have no repeated anchor, nor one that begins like it.
        bits = min(len(self.anchors).bit_length() + 3, 24)
        shift = np.uint64(64 - int(_SHIFT) - bits)
        maybe = np.zeros(2**bits, bool)
        maybe[self.anchors >> shift] = True
        for data, owner, at, offset, size, anchor, _ in stretches(self.texts):
            kept = np.flatnonzero(maybe[anchor >> shift])
            place = np.minimum(np.searchsorted(self.anchors, anchor[kept]), len(self.anchors) - 1)
            found = self.anchors[place] == anchor[kept]
            kept, place = kept[found], place[found]
            if not len(kept):
                continue
            hot = self.hot[place]
            cold, warm = kept[~hot], kept[hot]
            # Strings of a split anchor stand alone, under a key of their own.
            each = size[warm]
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            alone = np.repeat(at[warm], each) + step
            begin = np.r_[at[cold], alone]
            strings = np.r_[size[cold], np.ones(len(alone), np.int64)]
            where = np.r_[offset[cold], np.repeat(offset[warm], each) + step]
            text = np.r_[owner[cold], np.repeat(owner[warm], each)]
            contents = [data[a:b] for a, b in zip(begin.tolist(), (begin + strings + LENGTH - 1).tolist(), strict=True)]
            keys = anchor[cold]
            if len(alone):
                own = [int.from_bytes(hashlib.blake2b(c, digest_size=6).digest(), "big") for c in contents[len(cold) :]]
                keys = np.r_[keys, np.array(own, np.uint64)]
            yield contents, text, where, strings, keys


def _numbering() -> defaultdict[bytes, int]:
    """Numbers stretches from 0 on, in the order in which each is met first."""
    return defaultdict(itertools.count().__next__)


def _numbers_of(contents: list[bytes], number: defaultdict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, contents), np.int64, len(contents))


def _by_key(numbers: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all stretches by key, and their keys: those with one key are neighbours, in the part's index too."""
    key = np.empty(n, np.uint64)
    key[numbers] = keys
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _sent_stretches(bits: int):
    """Distinct stretches of each cell, with the smallest id that has each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            cell = Cell(table)
            number = _numbering()
            numbers, docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for contents, text, _, _, own in cell.repeated():
                numbers.append(_numbers_of(contents, number))
                docs.append(cell.ids[text])
                keys.append(own)
            numbers, every = np.concatenate(numbers), list(number)
            least = np.full(len(every), NOBODY)
            np.minimum.at(least, numbers, np.concatenate(docs))
            order, keys = _by_key(numbers, np.concatenate(keys), len(every))
            docs = least[order]
            every = [every[i] for i in order.tolist()]
            length = np.fromiter(map(len, every), np.uint8, len(every))
            rows = []
            for part, own in _by_part(_part_of(keys, bits)):
                data = b"".join(map(every.__getitem__, own.tolist()))
                rows.append((part, table["cell"][0].as_py(), _STRETCHES, compressed(_steps(keys[own]), _bytewise(docs[own]), length[own], data, level=_LEVEL)))
            yield _messages(rows)

    return run


# The index ----------------------------------------------------------------


def suffix_array(symbols: np.ndarray, number: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling.

    The symbols are stretches (from 1 on), each followed by an end (0).  Ends are ordered
    like their stretches, whose ``number`` every position has, so that no suffix is
    compared beyond its end, ``to_end`` positions away.
    """
    n, width = len(symbols), 5
    padded = np.zeros(n + width, np.int64)
    padded[:n] = symbols
    # Five symbols of nine bits, and the number of the end if they reach it, in one number.
    rank = np.zeros(n, np.int64)
    for k in range(width):
        rank = rank << 9 | np.where(to_end > k, padded[k : k + n], 0)
    rank = rank << 18 | np.where(to_end < width, number, 0)
    order = np.argsort(rank)
    step = rank[order]
    fresh = np.r_[True, step[1:] != step[:-1]]
    # A rank is the first place of equal ones, which no later round changes: only those that tie go on.
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
    while len(tied):
        own = order[tied]
        following = np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0)
        step = rank[own] * (n + 1) + following
        by_step = np.argsort(step)
        own, step = own[by_step], step[by_step]
        order[tied] = own
        fresh = np.r_[True, step[1:] != step[:-1]]
        rank[own] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.r_[fresh[1:], True])]
        width *= 2
    return order


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of stretches, with samples at run ends.

    The text is all stretches, each followed by an end; ends sort before all bytes, and in
    the order of the stretches.  For every run the transform keeps its symbol, its first row,
    where its rows lead (the rows of the suffixes one symbol longer are consecutive), and how
    far the suffixes there agree with the rows above the first and below the last one.
    Inside a run that agreement is one more than the one in the run, so no row needs its own.
    """

    def __init__(self, contents: list[bytes]):
        self.sizes = np.array([len(c) for c in contents], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1
        codes = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
        symbols = codes.astype(np.int64) + 1
        symbols[ends] = 0
        self.n = len(symbols)
        number = np.repeat(np.arange(len(contents)), self.sizes + 1)
        to_end = ends[number] - np.arange(self.n)
        order = suffix_array(symbols, number, to_end)
        last = symbols[order - 1]
        self.starts = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        self.heads = last[self.starts]
        lengths = np.diff(np.r_[self.starts, self.n])
        by_symbol = np.argsort(self.heads, kind="stable")
        before = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.leads = np.empty(len(self.starts), np.int64)
        self.leads[by_symbol] = before
        after = self.leads + lengths
        agreement = _Agreement(codes, to_end)
        self.above = agreement.of(order[self.leads], order[self.leads - 1])
        self.above[self.leads == 0] = 0
        self.below = agreement.of(order[after - 1], order[after % self.n])
        self.below[after == self.n] = 0

    def matching_statistics(self) -> Iterator[tuple[np.ndarray, ...]]:
        """From the ends backwards, one symbol of all stretches at a time: the stretches still
        open, the position in them, their rows, and how far each agrees with the rows above and below.

        The longest match of a position elsewhere in the text is the larger of its agreements
        with the rows above and below.
        """
        open_ = np.arange(len(self.sizes))
        row = open_.copy()  # ends come first, in the order of the stretches
        above, below = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        position = self.sizes.copy()
        lengths = np.diff(np.r_[self.starts, self.n])
        # The run of a row: how many runs begin up to it, by bits that mark where they do.
        marks = np.zeros(-(-self.n // 64) * 64, bool)
        marks[self.starts] = True
        marks = np.packbits(marks, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(marks), dtype=np.int64) - 1
        while len(open_):
            word = row >> 6
            run = before[word] - np.bitwise_count(marks[word] >> (row & 63).astype(np.uint64) >> np.uint64(1))
            inside = row - self.starts[run]
            above = np.where(inside == 0, self.above[run], above + 1)
            below = np.where(inside == lengths[run] - 1, self.below[run], below + 1)
            row = self.leads[run] + inside
            position = position - 1
            yield open_, position, row, above, below
            more = position > 0
            open_, row, position, above, below = (x[more] for x in (open_, row, position, above, below))


class _Agreement:
    """How many bytes two suffixes share before the end of either, up to ``LENGTH`` and a few more."""

    def __init__(self, codes: np.ndarray, to_end: np.ndarray):
        padded = np.zeros(len(codes) + LENGTH + 16, np.uint8)
        padded[: len(codes)] = codes
        # Eight bytes from each position on as one number, the first byte lowest.
        self.words = np.zeros(len(padded) - 8, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(self.words)].astype(np.uint64) << np.uint64(8 * k)
        self.to_end = to_end

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared, rows = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(0, LENGTH, 8):
            differ = self.words[a[rows] + k] ^ self.words[b[rows] + k]
            # The lowest bit that differs is in the first byte that does.
            low = differ & (~differ + np.uint64(1))
            shared[rows] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            rows = rows[differ == 0]
        return np.minimum(shared, np.minimum(self.to_end[a], self.to_end[b]))


def smallest_owners(contents: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For every string of every stretch the smallest id whose stretch holds it."""
    least, strings = _least(contents, docs)
    return np.split(least, np.cumsum(strings)[:-1])


def _least(contents: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all stretches in one row, and how many strings each has."""
    index = RunIndex(contents)
    strings = index.sizes - LENGTH + 1
    first = np.cumsum(strings) - strings
    linked = np.zeros(index.n + 1, bool)  # does a row hold the same string as the row above
    rows = np.empty(strings.sum(), np.int64)
    for open_, position, row, above, below in index.matching_statistics():
        whole = position < strings[open_]
        open_, position, row = open_[whole], position[whole], row[whole]
        rows[first[open_] + position] = row
        linked[row] |= above[whole] >= LENGTH
        linked[row + 1] |= below[whole] >= LENGTH
    string = (np.cumsum(~linked[:-1]) - 1)[rows]
    least = np.full(index.n, NOBODY)
    np.minimum.at(least, string, np.repeat(docs, strings))
    return least[string], strings


def _owners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell the smallest ids of the strings in its stretches, in their order."""
    for table in groups(batches, 1):
        part, cells = table["part"][0].as_py(), table["cell"].to_pylist()
        number = _numbering()
        numbers, ids, keys = [], [], []
        for blob in table["data"]:
            steps, docs, length, data = restored(blob.as_py())
            ends = np.cumsum(np.frombuffer(length, np.uint8), dtype=np.int64).tolist()
            numbers.append(_numbers_of([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], number))
            ids.append(_numbers(docs, np.int64))
            keys.append(_risen(steps))
        contents, every = list(number), np.concatenate(numbers)
        least = np.full(len(contents), NOBODY)
        np.minimum.at(least, every, np.concatenate(ids))
        order, key = _by_key(every, np.concatenate(keys), len(contents))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        # A stretch that is the only one of its key shares no string with another: it has one id, others one for each string.
        alone = np.repeat(np.diff(edges) == 1, np.diff(edges))
        strings = np.fromiter(map(len, contents), np.int64, len(contents)) - LENGTH + 1
        single, several = order[alone], order[~alone]
        values, begin, size = [least[single]], 0, 0
        held = np.cumsum(strings[several] + LENGTH - 1)
        # Equal strings have equal keys: an index ends where a key does.
        last = np.r_[key[~alone][1:] != key[~alone][:-1], True][: len(several)]
        for end in (np.flatnonzero(last) + 1).tolist():
            if held[end - 1] - size > _INDEX or end == len(several):
                block = several[begin:end]
                values.append(_least([contents[i] for i in block.tolist()], least[block])[0])
                begin, size = end, held[end - 1]
        ids = np.concatenate(values)
        own = np.r_[single, several]
        count, place, times = strings.copy(), np.empty(len(own), np.int64), np.ones(len(own), np.int64)
        count[single], times[single] = 1, strings[single]
        place[own] = np.cumsum(count[own]) - count[own]
        rows = []
        for cell, own in zip(cells, numbers, strict=True):
            sizes = count[own]
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = ids[np.repeat(place[own], sizes) + step]
            # Neighbours mostly agree.
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            total = np.add.reduceat(np.repeat(times[own], sizes), first)
            rows.append((part, cell, _OWNERS, compressed(_bytewise(found[first]), _bytewise(total), level=_LEVEL)))
        yield _messages(rows)


# Results ------------------------------------------------------------------


def _cut(bits: int):
    """Rows with their removed bytes counted and the rest hashed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            cell = Cell(table)
            repeated = list(cell.repeated())
            # Which ids the strings of each distinct stretch have, in the order in which they were sent.
            number = _numbering()
            numbers = [_numbers_of(contents, number) for contents, *_ in repeated]
            sizes = np.fromiter(map(len, number), np.int64, len(number)) - LENGTH + 1
            every = np.concatenate([np.zeros(0, np.int64), *numbers])
            order, keys = _by_key(every, np.concatenate([np.zeros(0, np.uint64), *(keys for *_, keys in repeated)]), len(number))
            place = np.empty(len(number), np.int64)
            least, base = [np.zeros(0, np.int64)], 0
            for part, own in _by_part(_part_of(keys, bits)):
                values, times = restored(cell.owners[part])
                least.append(np.repeat(_numbers(values, np.int64), _numbers(times, np.int64)))
                own = order[own]
                place[own] = base + np.cumsum(sizes[own]) - sizes[own]
                base += len(least[-1])
            owners = np.concatenate(least)
            # All texts in one row of bytes; a string that goes adds one from its start to its end.
            length = np.array([len(text) for text in cell.texts], np.int64)
            begin = np.cumsum(length + 1) - (length + 1)
            covered = np.zeros(int((length + 1).sum()), np.int8)  # no more than LENGTH strings cover a byte
            for (_, text, where, strings, _), own in zip(repeated, numbers, strict=True):
                step = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
                smaller = owners[np.repeat(place[own], strings) + step] < np.repeat(cell.ids[text], strings)
                start = (np.repeat(begin[text] + where, strings) + step)[smaller]
                if len(start):
                    # Every string starts but once, so that no place is counted twice.
                    covered[start] += 1
                    covered[start + LENGTH] -= 1
            gone_everywhere = np.cumsum(covered, dtype=np.int8) > 0
            rows = []
            for i, text in enumerate(cell.texts):
                removed, kept = [], text
                gone = gone_everywhere[begin[i] : begin[i] + length[i]]
                if gone.any():
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    removed = edges.reshape(-1, 2).tolist()
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                doc_id = int(cell.ids[i]) if cell.known[i] else None
                rows.append((doc_id, len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), removed))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _RESULT)

    return run


_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]


def remove_repeats(docs: DataFrame, part_bits: int | None = None) -> DataFrame:
    """Every text without the bytes of its strings that also start in a row with a smaller id.

    Texts are UTF-8 bytes, a null one is empty.  A null id is larger than any other, and
    rows with equal ids do not take from each other.  Strings are judged on the input, may
    overlap, and never cross rows.  One row per input row: ``doc_id, n_bytes, n_removed,
    n_spans, kept_sha256`` and ``removed``, the first byte and the end of each span.

    The messages of a cell to a part are one row each; there are ``2 ** part_bits`` parts,
    by default as many as the bytes of the texts ask for, so that a part fits into a task.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.lit(False).alias("flag"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def by(df: DataFrame, first: str, second: str) -> DataFrame:
        other = [name for name in ("part", "cell", "kind", "data") if name != first]
        return df.select(first, *other).repartition(first).sortWithinPartitions(first, second, "kind")

    if part_bits is None:
        part_bits = parts_for(rows, _PART, _PARTS).bit_length() - 1
    cells = packed_cells(rows, *_CELL, level=_LEVEL)
    named = cells.mapInArrow(_named_anchors(part_bits), _MESSAGE)
    repeated = by(named, "part", "cell").mapInArrow(_repeated_anchors, _MESSAGE)
    packed = cells.select(F.lit(0).cast("bigint").alias("part"), "cell", F.lit(_TEXTS).alias("kind"), "data")
    repeated = written(repeated)
    sent = by(packed.unionByName(repeated), "cell", "part").mapInArrow(_sent_stretches(part_bits), _MESSAGE)
    owners = by(sent, "part", "cell").mapInArrow(_owners, _MESSAGE)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<array<bigint>>"
    return by(packed.unionByName(repeated).unionByName(owners), "cell", "part").mapInArrow(_cut(part_bits), schema)
