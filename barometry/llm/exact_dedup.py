"""Exact duplicates by deterministic block naming.

Every text, without white space, is cut into blocks of a fixed size.  Equal blocks
sort next to each other and get one integer as their name, different blocks different
ones.  Adjacent names of a text are paired and the pairs named in the same way, until
one name is left per text.  Two texts of as many blocks are equal exactly if their last
names are; no hash decides.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, binary_column, bounded_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096  # bytes
_SLICE = 2**23  # bytes of text whose blocks are gathered before they are shuffled
_UNPACKED = 2**22  # bytes of places that become rows at once
_PLACE = [("row", "<i8"), ("slot", "<i8")]
_ABOUT = [*_PLACE, ("doc_id", "<i8"), ("known", "?"), ("points", "<i8"), ("blocks", "<i8"), ("sha", "V32")]
_NAME_BITS = 40  # names of one partition


def _gathered(keys: list[bytes], places: np.ndarray) -> pa.RecordBatch:
    """One row per distinct key with all places where it stands."""
    encoded = binary_column(keys).dictionary_encode()
    codes = encoded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(encoded.dictionary)))
    packed = [part.tobytes() for part in np.split(places[order], ends[:-1])]
    return pa.record_batch([encoded.dictionary, binary_column(packed)], ["key", "places"])


def _blocks(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, _SLICE):
            rows, ids, values = (column.to_pylist() for column in batch.columns)
            keys: list[bytes] = []
            about: list[tuple] = []
            for row, doc_id, text in zip(rows, ids, values, strict=True):
                plain = text.encode().translate(None, SPACES)
                own = [plain[i : i + size] for i in range(0, len(plain), size)] or [b""]
                sha = hashlib.sha256(plain).digest()
                for slot, block in enumerate(own):
                    keys.append(block)
                    about.append((row, slot, doc_id or 0, doc_id is not None, len(text), len(own), sha))
            yield _gathered(keys, np.array(about, _ABOUT))

    return run


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            row, slot, a, b = (column.to_numpy() for column in batch.columns)
            places = np.empty(len(row), _PLACE)
            places["row"], places["slot"] = row, slot
            names = np.stack([a, b], axis=1).astype(">i8")
            yield _gathered([name.tobytes() for name in names], places)


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names for sorted keys; their places stay packed."""
    name = (TaskContext.get().partitionId() << _NAME_BITS) - 1
    last = None
    for batch in batches:
        names = []
        for key in batch.column(0).to_pylist():
            if key != last:
                name, last = name + 1, key
            names.append(name)
        yield pa.record_batch([pa.array(names, pa.int64()), batch.column(1)], ["name", "places"])


def _placed(fields: list[tuple[str, str]]):
    """A row for each place of a name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, _UNPACKED):
            parts = [np.frombuffer(packed, fields) for packed in batch.column(1).to_pylist()]
            places = np.concatenate(parts)
            columns = {n: places[n] for n, _ in fields}
            columns["name"] = np.repeat(batch.column(0).to_numpy(), [len(part) for part in parts])
            if "sha" in columns:
                columns["sha"] = binary_column(x.tobytes() for x in places["sha"])
            yield pa.record_batch({n: pa.array(v) for n, v in columns.items()})

    return run


def _give_names(gathered: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    kinds = {"<i8": "bigint", "?": "boolean", "V32": "binary"}
    schema = ", ".join(f"{name} {kinds[kind]}" for name, kind in fields) + ", name bigint"
    named = gathered.repartition("key").sortWithinPartitions("key").mapInArrow(_named, "name bigint, places binary")
    # The packed places of a frequent key are dealt out by what they hold before they become rows.
    return named.repartition("places").mapInArrow(_placed(fields), schema)


def exact_duplicates(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """Which document stays of each group of texts equal up to white space.

    Of a group the row with the most characters (code points of the whole text) stays,
    then the one with the smallest ``doc_id``, a null id last; of rows that agree even in
    these exactly one.  A null text is an empty one, and all texts without anything but
    white space are equal.  One row per input row: ``row`` (the column ``row`` of the input, or a
    number in the order of this scan), ``doc_id, keep_id, group_size, kept, text_sha256`` (of the text without white
    space), and ``n_chars_text``.

    Blocks that occur often, and pairs of names, are gathered with their places before
    the shuffle, so that a task gets one row of them per slice of input and not per document.
    Named places are dealt out again, still packed, and become rows there: no task makes the rows
    of all places of one block.  An empty table gives no rows.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = written(_give_names(rows.mapInArrow(_blocks(block), "key binary, places binary"), _ABOUT))
    longest = first.agg(F.max("blocks")).first()[0] or 1
    names = first.filter("blocks > 1").select("row", "slot", "name")
    # The number of rounds follows from the longest text alone: each halves the names of a text.
    for _ in range((longest - 1).bit_length()):
        even = F.col("slot") % 2 == 0
        paired = names.groupBy("row", F.shiftright("slot", 1).alias("slot")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        )
        # In one order, so that a task that runs again packs the same places together.
        paired = paired.sortWithinPartitions("row", "slot")
        names = _give_names(paired.mapInArrow(_pairs, "key binary, places binary"), _PLACE)
    about = first.filter("slot = 0").withColumn("doc_id", F.when(F.col("known"), F.col("doc_id")))
    kept_columns = ["row", "doc_id", "points", "blocks", "sha", "name"]
    long = about.filter("blocks > 1").drop("name").join(names.select("row", "name"), "row")
    # Written, since both uses below must see the same names.
    identified = written(about.filter("blocks = 1").select(*kept_columns).unionByName(long.select(*kept_columns)))
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    # Written, so that the join below deals out both sides itself and can split a large group.
    groups = written(
        identified.groupBy("blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    )
    return identified.join(groups, ["blocks", "name"]).select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("points").alias("n_chars_text"),
    )
