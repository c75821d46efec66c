"""Token counts of a piece vocabulary with byte fallback, by merging arrays.

A text is cut where a non-space meets a space: no piece of such a vocabulary goes
across, so that the parts merge independently.  The parts that are not known yet are
held together as one ragged array.  In a round every part applies its best pair, all of
them at once; what is left when no pair can merge are the tokens.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import bounded_batches, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 4096  # tokens
_SPACE = "▁"  # how the vocabulary writes a space
_NEVER = np.int32(2**31 - 1)
_CHUNK = 2**21  # bytes of text whose parts are held at once
_KNOWN = 400_000  # parts whose counts are remembered; beyond it they are counted anew
_LONG = 64  # characters; longer parts are not remembered, so that what is remembered has a bound in bytes
_PART = re.compile(" *[^ ]+| +")
_CUT = re.compile("[^ ] ")


class PieceMerger:
    """Merges of a vocabulary of scored pieces."""

    def __init__(self, pieces: dict[str, float]):
        # Symbols are pieces, and the characters that occur only inside of pieces.
        self.ids = {piece: i for i, piece in enumerate(pieces)}
        for piece in pieces:
            for char in piece:
                self.ids.setdefault(char, len(self.ids))
        self.n = len(self.ids)
        order = {score: i for i, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {piece: order[score] for piece, score in pieces.items()}
        ties = np.bincount(list(rank.values()), minlength=len(order)) > 1
        splits = [
            (self.ids[piece[:k]] * self.n + self.ids[piece[k:]], rank[piece], self.ids[piece])
            for piece in pieces
            for k in range(1, len(piece))
            if piece[:k] in self.ids and piece[k:] in self.ids
        ]
        keys, ranks, merged = np.array(splits or [(-1, 0, 0)], np.int64).T
        by_key = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[by_key], ranks[by_key].astype(np.int32), merged[by_key].astype(np.int32)
        # Equal pairs of a part merge together only where that equals one after the other: after it
        # no pair with the new symbol may rank before or level with the one just applied.
        own = np.full(self.n, -1, np.int32)
        for piece, r in rank.items():
            if len(piece) > 1:
                own[self.ids[piece]] = r
        self.single = np.zeros(len(order), bool)
        for side in (self.keys // self.n, self.keys % self.n):
            known = own[side] >= 0
            self.single[own[side][known & (self.ranks <= own[side])]] = True
        self.single |= ties
        # Tokens that a symbol stands for at the end: its bytes where it is no piece.
        self.weight = np.ones(self.n + 1, np.int64)
        for symbol, i in self.ids.items():
            if symbol not in pieces:
                self.weight[i] = len(symbol.encode())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.n + right
        keys[(left == self.n) | (right == self.n)] = -2
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], _NEVER), np.where(found, self.merged[at], 0)

    def counts(self, parts: list[str]) -> np.ndarray:
        """Number of tokens of each part, none of them empty."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = "".join(parts)
        codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, place = np.unique(codes, return_inverse=True)
        unknown = self.n
        table = np.array([self.ids.get(chr(c), unknown) for c in distinct], np.int32)
        size = np.where(distinct < 0x80, 1, np.where(distinct < 0x800, 2, np.where(distinct < 0x10000, 3, 4)))
        symbol = table[place]
        part = np.repeat(np.arange(len(parts)), length)
        # A character of no piece merges with nothing; its bytes are its tokens.
        total = np.bincount(part, np.where(symbol == unknown, size[place], 0), len(parts)).astype(np.int64)
        joined = np.r_[part[1:] == part[:-1], False]
        rank, merged = np.full(len(symbol), _NEVER, np.int32), np.zeros(len(symbol), np.int32)
        at = np.flatnonzero(joined)
        rank[at], merged[at] = self._ranks(symbol[at], symbol[at + 1])
        weight = self.weight.copy()
        weight[unknown] = 0
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            best = np.minimum.reduceat(rank, starts)
            open_ = best < _NEVER
            sizes = np.diff(np.r_[starts, len(part)])
            if not open_.all():  # parts without a pair are done
                done = np.repeat(~open_, sizes)
                total += np.bincount(part[done], weight[symbol[done]], len(parts)).astype(np.int64)
                symbol, part, rank, merged = (x[~done] for x in (symbol, part, rank, merged))
                starts, sizes, best = np.cumsum(np.r_[0, sizes[open_]])[:-1], sizes[open_], best[open_]
                if not len(symbol):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = part[chosen]
            first = np.r_[True, owner[1:] != owner[:-1]]
            # Of pairs that overlap, every other one from the left.
            run = np.r_[True, (chosen[1:] != chosen[:-1] + 1) | first[1:]]
            since = np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            chosen = chosen[np.where(self.single[rank[chosen]], first, since % 2 == 0)]
            symbol[chosen] = merged[chosen]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            changed = np.cumsum(keep)[chosen] - 1
            symbol, part, rank, merged = (x[keep] for x in (symbol, part, rank, merged))
            for at in (changed, changed[changed > 0] - 1):
                inside = np.zeros(len(at), bool)
                inner = at < len(part) - 1
                inside[inner] = part[at[inner]] == part[at[inner] + 1]
                rank[at[~inside]] = _NEVER
                at = at[inside]
                rank[at], merged[at] = self._ranks(symbol[at], symbol[at + 1])
        return total


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a vocabulary file whose texts are taken as they are, with a space in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = range(model.get_piece_size())
    special = {i for i in known if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    return {model.id_to_piece(i): model.get_score(i) for i in known if i not in special}


def _parts(text: str) -> Iterator[list[str]]:
    """Parts of a text, each with the spaces in front of it, in lists of bounded size."""
    text = " " + text.replace(_SPACE, " ")
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + _CHUNK) if len(text) - start > 2 * _CHUNK else None
        end = cut.start() + 1 if cut else len(text)
        section = text[start:end]
        if "  " in section or section[-1] == " ":
            yield _PART.findall(section)
        else:
            yield [f" {word}" for word in section[1:].split(" ")]
        start = end


def _counter(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = PieceMerger(read_pieces(path))
        known: dict[str, int] = {}
        for batch in bounded_batches(batches, _CHUNK):
            values = batch.column(1).to_pylist()
            totals = np.zeros(len(values), np.int64)
            held: list[tuple[int, list[str]]] = []
            size = 0

            def settle() -> None:
                if len(known) > _KNOWN:
                    known.clear()
                new = list({part for _, parts in held for part in parts} - known.keys())
                if new:
                    found = merger.counts([part.replace(" ", _SPACE) for part in new])
                    known.update(zip(new, found.tolist(), strict=True))
                for row, parts in held:
                    totals[row] += sum(map(known.__getitem__, parts))
                held.clear()
                for part in new:
                    if len(part) > _LONG:
                        del known[part]

            for row, text in enumerate(values):
                for parts in _parts(text) if text else ():
                    held.append((row, parts))
                    size += len(parts)
                    if size > _CHUNK // 4:
                        settle()
                        size = 0
            settle()
            n_bytes = [len(text.encode()) for text in values]
            yield pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Number of tokens of every whole text.

    A null text counts as empty: no bytes, no tokens.  Rows are counted one by one, so
    repeated rows and null ids come back as they are.  An empty table gives none, and columns
    other than ``doc_id`` and ``text`` are not read.  ``vocabulary`` is the path of the
    vocabulary file on every executor.

    A worker remembers the counts of so many parts of at most so many characters.  Besides it holds
    2 MB of text, or one text with arrays over its longest part where that is longer.
    """
    counted = texts(docs).mapInArrow(_counter(vocabulary), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)
