"""Shards by rendezvous hashing: every record goes to the shard that bids lowest for its key.

A shard's bid depends on the key and on that shard alone.  One more shard therefore
takes records only into itself, and a shard that goes gives away only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written

SHARDS = 40
OVERHEAD = 16  # bytes that a record takes besides its text
SLICES = 1024  # parts of a shard that are numbered on their own
_DIGITS = 12  # hexadecimal digits of the hash that are used: 48 bits


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight for a hash u of key and shard between 0 and 1: the lowest bid wins.

    A shard wins keys in proportion to its weight.
    """
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, _DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.log(u) / weight


def place(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """Adds ``shard``, and ``grown_shard``: the shard with one more of them.

    ``weights`` has one for each shard and one for the further shard; all are equal if it
    is None.  A null id is a key of its own.
    """
    weights = list(weights) if weights is not None else [1.0] * (shards + 1)
    if len(weights) != shards + 1 or min(weights) <= 0:
        raise ValueError("one positive weight per shard and one for a further shard is needed")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    shares = F.array(*map(F.lit, weights))
    bids = F.transform(
        F.sequence(F.lit(0), F.lit(shards)),
        lambda s: F.struct(bid(key, s, F.get(shares, s)).alias("bid"), s.alias("shard")),
    )
    offered = docs.withColumn("bids", bids)
    return offered.withColumns(
        {
            "shard": F.array_min(F.slice("bids", 1, shards))["shard"],
            "grown_shard": F.array_min("bids")["shard"],
        }
    ).drop("bids")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, slices: int = SLICES
) -> DataFrame:
    """Shard of every document, and its slot there, counted from 0 without a gap.

    The law is ``key``: id and number of shards decide.  ``size`` is the UTF-8 length of
    the text (none for a null one) plus 16, ``text_crc32`` the checksum of the text.
    Rows with the same id, null ids among them, are in the same shard; repeated rows each
    get a slot.  A shard is numbered slice by slice, so that no task holds more than a slice.
    """
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length("text") + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    # Each part modulo the slices first, since the sum of both need not fit into a bigint.
    parts = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(slices)) + F.pmod("text_crc32", F.lit(slices))
    placed = written(place(rows, shards, weights).withColumn("slice", F.pmod(parts, F.lit(slices)).cast("int")))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard and slice, whatever the number of documents.
    starts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("position", F.row_number().over(order) - 1)
    return numbered.join(starts, ["shard", "slice"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("position")).cast("bigint").alias("slot"),
        "grown_shard",
    )
