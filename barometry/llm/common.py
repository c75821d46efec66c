"""What several text operators share: clean input columns, written tables, cells.

Rows of ``documents`` may lack any value and may repeat.  Every operator reads only
the columns it names, so that further columns, whatever they are called, do no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import remove, shared_folder

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, of UTF-8 bytes
_ASCII_LOWER = {code: code + 32 for code in range(65, 91)}
NOBODY = 2**63 - 1  # in place of a null id: larger than any other
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, a null text as the empty one."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are written within are removed at its end; more paths may be added to the list."""
    own: list[str] = []
    _TEMPORARY.append(own)
    try:
        yield own
    finally:
        _TEMPORARY.remove(own)
        for path in own:
            remove(spark, path)


def written_to(df: DataFrame) -> str:
    """The path in the shared folder of a new table of the rows of ``df``, which nobody removes."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, its lineage cut."""
    path = written_to(df)
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to be no column of ``df``."""
    taken = {column.lower() for column in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)).cast("int")


def ascii_lower(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def lower_bytes(text: bytes) -> bytes:
    return text.translate(_LOWER)


def words_of(text: str) -> list[bytes]:
    """Words between white space (space and the codes 9 to 13), A-Z in lower case, as UTF-8."""
    return text.encode().translate(_LOWER).split()


def bounded_batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` bytes each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.zeros(batch.num_rows)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
                length += np.diff(offsets)
        group = (np.cumsum(length) // size).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def compressed(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    whole = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)
    return struct.pack("<q", len(whole)) + pa.Codec("zstd", compression_level=level).compress(whole, asbytes=True)


def restored(blob: bytes) -> list[bytes]:
    whole = pa.decompress(blob[8:], *struct.unpack_from("<q", blob), "zstd", asbytes=True)
    (n,) = struct.unpack_from("<q", whole)
    edges = list(accumulate(struct.unpack_from(f"<{n}q", whole, 8), initial=8 * (n + 1)))
    return [whole[a:b] for a, b in pairwise(edges)]


def packed_cells(rows: DataFrame, most: int, size: int, level: int = 1) -> DataFrame:
    """``cell, data``: consecutive ``rows (doc_id, flag, text)`` in cells, one row each.

    A cell ends after ``most`` rows or ``size`` bytes of text.  Written, since a scan of the
    rows may be cut otherwise each time: all later steps read the same cells.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, n = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, flag, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append((doc_id, flag, text.encode()))
                n += len(held[-1][2])
                if len(held) >= most or n >= size:
                    yield _cell(cell, held, level)
                    cell, held, n = cell + 1, [], 0
        if held:
            yield _cell(cell, held, level)

    return written(rows.mapInArrow(run, "cell bigint, data binary"))


def parts_for(rows: DataFrame, size: int, least: int) -> int:
    """A power of two: ``least`` parts, or so many that each has at most ``size`` bytes of the texts on average."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    while least * size < total:
        least *= 2
    return least


def _cell(cell: int, held: list[tuple], level: int) -> pa.RecordBatch:
    ids, flags, texts = zip(*held, strict=True)
    number = np.array([x if x is not None else NOBODY for x in ids], np.int64)
    known = np.array([x is not None for x in ids])
    length = np.array([len(text) for text in texts], np.int64)
    data = compressed(number, known, np.array(flags, bool), length, b"".join(texts), level=level)
    return pa.record_batch([pa.array([cell]), pa.array([data], pa.binary())], ["cell", "data"])


def cell_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Ids (``NOBODY`` for null), whether they are known, flags and texts of a cell."""
    number, known, flags, length, whole = restored(data)
    ends = np.cumsum(np.frombuffer(length, np.int64)).tolist()
    texts = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return np.frombuffer(number, np.int64), np.frombuffer(known, bool), np.frombuffer(flags, bool), texts


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the bits of ``x`` over the whole number."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def binary_column(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``keys`` columns (integers), one table per group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        changed = np.zeros(batch.num_rows, bool)
        changed[0] = last is not None and last != tuple(c[0] for c in columns)
        for column in columns:
            changed[1:] |= column[1:] != column[:-1]
        start = 0
        for end in np.flatnonzero(changed):
            if end > start:
                held.append(batch.slice(start, end - start))
            yield pa.Table.from_batches(held)
            held, start = [], end
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def word_edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between white space begin and end."""
    inside = np.r_[False, ~_IS_SPACE[codes], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, places: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word between white space, of UTF-8 bytes; with ``places`` where they begin, too."""
    codes = np.frombuffer(data, np.uint8)
    starts, ends = word_edges(codes)
    hashes = _hashes(codes, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return (hashes, starts) if places else hashes


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # Every word as a polynomial in an odd number, brought down from its place in the text.
    power, inverse = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from 0 to n - 1 at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * n, 2**16)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.multiply.accumulate(factors))
    return _POWERS[0][:n], _POWERS[1][:n]
