"""Packing of tokenised documents into sequences of a fixed length, by minimum bin slack.

Which lengths go together is decided on the number of pieces of each length alone, of
which there are no more than tokens in a sequence.  The largest length left takes a
sequence; subset sums over the lengths left, held as the bits of one integer, tell the
fullest way to fill the rest.  That pattern is used as often as there are pieces for
it, and the pieces are taken out.  Spark numbers the pieces of each length and puts each
into its place.
"""

from __future__ import annotations

import sys
import zlib
from base64 import b64decode
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048  # tokens of a sequence
_END = b"\0\0\0\0"  # id 0 ends a document
_SLICE = 2**21  # bytes of text at once
_KNOWN = 300_000  # parts of short texts whose ids are remembered
_LONG = 64  # characters; of longer texts nothing is remembered, so that what is remembered has a bound in bytes
_SLICES = 1024  # parts of a length that are numbered on their own


# Tokens -------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by the byte-level vocabulary, as little-endian 32-bit integers.

    A text is encoded in one call, which takes half the time of looking its parts up.  Short
    texts, where both take about as long, are encoded part by part and parts are looked up once
    known: a space between two characters that are not white space always begins a new token.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=merges, special_tokens=special)
        self._known: dict[str, bytes | None] = {}

    def _plain(self, text: str) -> bytes:
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def _part(self, part: str) -> bytes | None:
        """The ids of a part behind a space, if they do not depend on its neighbours."""
        if part not in self._known:
            whole = part and not part[0].isspace() and not part[-1].isspace()
            self._known[part] = self._plain(f" {part}") if whole else None
        return self._known[part]

    def encode(self, text: str) -> bytes:
        if len(text) > _LONG:
            return self._plain(text)
        if len(self._known) > _KNOWN:
            self._known.clear()
        first, *parts = text.split(" ")
        found = [self._part(part) for part in parts]
        if first[-1:].strip() and None not in found:
            return b"".join([self._plain(first), *found])
        return self._plain(text)


def _pieces(make: tuple, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*make)
        for batch in bounded_batches(batches, _SLICE):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encoder.encode(text) + _END)
                total = len(ids) // 4
                end = total % capacity or min(total, capacity)
                start = piece = 0
                while start < total:
                    checksum = zlib.crc32(ids[4 * start : 4 * end])
                    rows.append((doc_id, piece, start, end - start, checksum))
                    start, end, piece = end, end + capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def tokenised_pieces(
    docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], capacity: int = CAPACITY
) -> DataFrame:
    """Documents as token ids with an end, those longer than ``capacity`` cut.

    All pieces but the first of a document are full.  A null text is empty and consists
    of its end alone.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return texts(docs).mapInArrow(_pieces((ranks, pattern, special), capacity), schema)


# Patterns -----------------------------------------------------------------


@dataclass
class Plan:
    """For every length the runs of its pieces that are placed alike, in order."""

    capacity: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0

    def add(self, pattern: dict[int, int], times: int, used: dict[int, int]) -> None:
        offset = 0
        for length, each in pattern.items():
            # First piece of the run, pieces of it per sequence, offset of the first, first sequence.
            self.runs.setdefault(length, []).append((used.get(length, 0), each, offset, self.sequences))
            used[length] = used.get(length, 0) + each * times
            offset += length * each
        self.sequences += times


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The lengths that together come closest to ``room``, the larger ones first.

    ``lengths`` are in falling order.  Bit s of an integer says whether some of the
    lengths seen so far add up to s; the integers of all steps lead back to the choice.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        most, times = min(counts[length], room // length), 1
        while most:
            times = min(times, most)
            steps.append((reach, length, times))
            reach |= reach << (length * times) & mask
            most -= times
            times *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns for so many pieces of each length, the fullest that holds the largest left."""
    counts = dict(sorted(histogram.items(), reverse=True))
    lengths = list(counts)
    used: dict[int, int] = {}
    plan = Plan(capacity)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        pattern = fullest(capacity - largest, lengths, counts)
        counts[largest] += 1
        pattern = {largest: pattern.pop(largest, 0) + 1} | pattern
        times = min(counts[length] // each for length, each in pattern.items())
        plan.add(pattern, times, used)
        for length, each in pattern.items():
            counts[length] -= each * times
        lengths = [length for length in lengths if counts[length]]
    return plan


# Places -------------------------------------------------------------------


def _placed(plan: Plan):
    """The runs travel as one array per length; there are a few per length of a piece."""
    runs = {length: np.array(parts, np.int64).T for length, parts in plan.runs.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            numbers = batch.column("number").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, each, start, base = runs[int(length)]
                at = np.searchsorted(first, numbers[own], side="right") - 1
                since = numbers[own] - first[at]
                sequence[own] = base[at] + since // each[at]
                offset[own] = start[at] + since % each[at] * length
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slices: int = _SLICES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of ``length`` up to ``capacity``.

    The pieces of a sequence follow each other without a gap.  Pieces of one length are
    numbered slice by slice, so that a length that many share is no task of its own; only
    the number of pieces per length reaches the driver.  Repeated rows are packed each.
    """
    mix = F.xxhash64("doc_id", "piece", "ids_crc32")
    pieces = written(pieces.withColumn("slice", F.pmod(mix, F.lit(slices)).cast("int")))
    per_slice = pieces.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    histogram = {row["length"]: row["n"] for row in per_slice.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = minimum_slack(histogram, capacity)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = per_slice.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("position", F.row_number().over(order) - 1).join(first, ["length", "slice"])
    numbered = numbered.withColumn("number", F.col("first") + F.col("position"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    return numbered.select(*columns).mapInArrow(_placed(plan), schema)


def pack_documents(
    docs: DataFrame, ranks: str, pattern: str, special: dict[str, int], capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece of a document with its sequence and place there.

    A null text is empty and becomes its end alone, one piece of one token.  Rows are packed one by
    one: repeated rows and null ids come back as often as they are, each with a place of its own.
    Lengths that tie are numbered by id, piece and checksum.  An empty table gives no rows, and
    columns other than ``doc_id`` and ``text`` are not read.
    """
    return pack(tokenised_pieces(docs, ranks, pattern, special, capacity), capacity)
