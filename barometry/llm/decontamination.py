"""Benchmark items in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are pairs of words that are neighbours or have one word between them.  In an
alignment of n words whose score is a share t of a full one, two words matched one after
the other have on average little more than one edit between them, and at least t * n - 1
such pairs have one at most: these are seeds, in the item and in the text.  Half of them
may therefore be left out on the side of the item, and it is the most frequent ones that
are, without losing a copy.  Texts and items are joined by the rare ones that are left.
Where enough of them stand close together, the text is aligned with the item around
them, so that edited and partly rewritten copies score high and chance hits low.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 3  # words of an item that may be edited; shorter ones are found as they are
THRESHOLD = 0.4  # of the score of a full copy; chance alignments stay below
MATCH, MISMATCH, GAP = 2, -1, -1
_BLOCK = 2**22  # bytes of items that are searched for in one pass over the texts
_SLICE = 2**21
# Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W_{_ALONE}]+")
_CUT = re.compile(r"[\W_]")


@dataclass
class Items:
    """Items of one pass: words by number, and the places of their seeds by the pair of words."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    keys: np.ndarray  # distinct pairs
    starts: np.ndarray  # places of pair k: starts[k] to starts[k + 1]
    items: np.ndarray
    offsets: np.ndarray
    needed: np.ndarray  # seeds that a copy of the item holds at least
    margin: np.ndarray  # words by which a copy may be longer
    short: dict[tuple[int, ...], list[int]]  # whole items of one or two words

    @classmethod
    def of(cls, rows: list[tuple[int, str]], threshold: float = THRESHOLD) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words, short = [], [], {}
        for item_id, text in rows:
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(text.lower())]
            if len(own) >= LEAST:
                ids.append(item_id)
                words.append(np.array(own, np.int32))
            elif own:
                short.setdefault(tuple(own), []).append(item_id)
        sizes = np.array([len(w) for w in words], np.int64)
        # A copy of n words that scores enough has so many pairs of neighbours with an edit between them at most.
        pairs = np.maximum(np.ceil(threshold * sizes - 1 - 1e-9), 1).astype(np.int64)
        dropped = (pairs - 1) // 2
        every = [np.concatenate([k for k, _ in pairs_of(w, len(vocabulary))]) for w in words]
        offsets = [np.concatenate([at for _, at in pairs_of(w, len(vocabulary))]) for w in words]
        known, counts = np.unique(np.concatenate(every or [np.zeros(0, np.int64)]), return_counts=True)
        kept = []
        for own, n in zip(every, dropped, strict=True):
            # The rarest seeds; without the n most frequent a copy has n fewer at most.
            kept.append(np.argsort(counts[np.searchsorted(known, own)], kind="stable")[: len(own) - n])
        keys = np.concatenate([own[at] for own, at in zip(every, kept, strict=True)] or [np.zeros(0, np.int64)])
        offset = np.concatenate([own[at] for own, at in zip(offsets, kept, strict=True)] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(words)), [len(at) for at in kept]) if words else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        distinct, starts = np.unique(keys[order], return_index=True)
        margin = np.maximum(np.ceil(MATCH * (1 - threshold) * sizes / -GAP), 0).astype(np.int64) + 1
        return cls(ids, words, vocabulary, distinct, np.r_[starts, len(keys)], owner[order], offset[order], pairs - dropped, margin, short)


def pairs_of(words: np.ndarray, base: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of known words next to each other, and with one between them: as numbers, and where they begin."""
    found = []
    for step in (1, 2):
        first, second = words[:-step].astype(np.int64), words[step:]
        at = np.flatnonzero((first >= 0) & (second >= 0))
        found.append((first[at] * base + second[at], at))
    return found


def numbered(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """Words of a whole text by their number in the items, -1 for words of no item."""
    parts, start = [], 0
    get = vocabulary.get
    while start < len(text):
        cut = _CUT.search(text, start + _SLICE)
        end = cut.end() if cut else len(text)
        found = _WORD.findall(text[start:end].lower())
        parts.append(np.fromiter((get(word, -1) for word in found), np.int32, len(found)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _hits(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Items that may have a copy in a text, and where one would begin, in order of both.

    For each seed of an item that stands in the text, where as many as a copy needs are
    close enough together to be of one.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(items.keys):
        return nothing
    item, begin = [], []
    for key, at in pairs_of(words, len(items.vocabulary)):
        place = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
        found = items.keys[place] == key
        at, place = at[found], place[found]
        sizes = items.starts[place + 1] - items.starts[place]
        every = np.repeat(items.starts[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        item.append(items.items[every])
        begin.append(np.repeat(at, sizes) - items.offsets[every])
    item, begin = np.concatenate(item), np.concatenate(begin)
    if not len(item):
        return nothing
    place = (item << 40) + begin + (1 << 39)
    place.sort()
    item, begin = place >> 40, (place & ((1 << 40) - 1)) - (1 << 39)
    last = np.arange(len(item)) + items.needed[item] - 1
    enough = last < len(item)
    enough[enough] = place[last[enough]] - place[enough] <= items.margin[item[enough]]
    change = np.zeros(len(item) + 1, np.int64)
    np.add.at(change, np.flatnonzero(enough), 1)
    np.add.at(change, last[enough] + 1, -1)
    kept = np.cumsum(change[:-1]) > 0
    return item[kept], begin[kept]


def _short(words: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """Items of one or two words that stand in a text as they are: number, first and last word of the first place."""
    if not items.short:
        return
    standing = set(words.tolist())
    for own in sorted(own for own in items.short if standing.issuperset(own)):
        at = np.flatnonzero(words[: len(words) - len(own) + 1] == own[0])
        for k, word in enumerate(own[1:], 1):
            at = at[words[at + k] == word]
        if len(at):
            for item_id in items.short[own]:
                yield item_id, int(at[0]), int(at[0]) + len(own) - 1


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of ``a`` in ``b``, and where it ends in either."""
    column = np.arange(len(b) + 1) * -GAP
    above = np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(a):
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(b == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        # A gap along the row: the running maximum, less what the gap costs.
        row = np.maximum.accumulate(row + column) - column
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), i + 1, end)
        above = row
    return best


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of an item in a stretch of words, and the first and last word of it."""
    score, i, end = _best_end(item, words)
    if not score:
        return 0, 0, 0
    _, _, length = _best_end(item[:i][::-1], words[:end][::-1])
    return score, end - length, end - 1


def copies(text: str, items: Items, threshold: float, present: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """Items that a text holds: id, score, first and last word.  ``present`` is scratch space, all false."""
    words = numbered(text, items.vocabulary)
    for item_id, first, last in _short(words, items):
        yield item_id, 1.0, first, last
    item, begin = _hits(words, items)
    for own in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
        if not len(own):
            continue
        number = item[own[0]]
        wanted, margin = items.words[number], int(items.margin[number])
        size = len(wanted)
        # Seeds whose stretches overlap are aligned together.
        first = begin[own]
        best = (0, 0, 0)
        for part in np.split(first, np.flatnonzero(np.diff(first) > size + 2 * margin) + 1):
            low = max(int(part[0]) - margin, 0)
            around = words[low : int(part[-1]) + size + margin]
            # At best every word of the item that stands here is a match.
            present[around] = True
            most = int(present[wanted].sum())
            present[around] = False
            if MATCH * most / (MATCH * size) < threshold:
                continue
            found = align(wanted, around)
            if found[0] > best[0]:
                best = (found[0], low + found[1], low + found[2])
        score = best[0] / (MATCH * size)
        if score >= threshold:
            yield items.ids[number], score, best[1], best[2]


def _scratch(items: Items) -> np.ndarray:
    return np.zeros(len(items.vocabulary) + 1, bool)  # the last one is for words of no item


def _aligned(items: Items, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _scratch(items)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in bounded_batches(batches, _SLICE):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(key, *found) for found in copies(text, items, threshold, present)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                [batch.schema.names[0], "item_id", "score", "first_word", "last_word"],
            )

    return run


def _clean(items: Items, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = _scratch(items)
        for batch in bounded_batches(batches, _SLICE):
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([next(copies(text or "", items, threshold, present), None) is None for text in texts]))

    return run


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    """The items in blocks of bounded size, one after the other."""
    wanted = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / _BLOCK))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for i in range(blocks):
        yield Items.of([tuple(row) for row in wanted.filter(block == i).orderBy("item_id", "text").collect()], threshold)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, that hold no copy of an item; see :func:`find_contamination`.

    A row is decided where it is aligned: none is numbered, copied or joined.  Between
    two blocks of items the rows are written, so that the driver has one block at a time.
    """
    kept = None
    for items in _blocks(benchmark, threshold):
        kept = (docs if kept is None else written(kept)).mapInArrow(_clean(items, threshold), docs.schema)
    return kept


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """Pairs of a text and a benchmark item that it holds a copy of, edited or not.

    One row per pair: ``key``, ``item_id``, ``score`` (of the best alignment, 1 for a full
    copy), ``first_word`` and ``last_word`` of it in the text, counted in words from 0.  Words
    are runs of letters and digits, or single characters of scripts that have no spaces
    between words.  An item of three words or more is found wherever an alignment reaches
    ``threshold``, which is above 1/3; one of one or two words where it stands as it is.
    Null texts hold nothing, and null items and those without words are in nothing.
    Repeated rows of either side repeat no pair of an item; a repeated text has its own.

    Items are searched for in blocks of bounded size, each in a pass over all texts, whose
    pairs are written before the next: driver and tasks hold one block, however large the
    benchmark.
    """
    rows = docs.select(F.col(key).cast("bigint").alias(key), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"{key} bigint, item_id bigint, score double, first_word bigint, last_word bigint"
    found = None
    for items in _blocks(benchmark, threshold):
        pairs = rows.mapInArrow(_aligned(items, threshold), schema)
        found = pairs if found is None else written(found).unionByName(pairs)
    return found
