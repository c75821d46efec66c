"""The trie of conversations: every distinct opening is a node, with counts and savings.

Conversations are sorted by their turns, so that a node is a run of consecutive ones.
They are cut into shards.  A shard has vertical bitmaps: for every position and turn
the set of its conversations that have this turn there, as a bitset.  The members of a
node are the members of its parent intersected with the bitmap of its turn; a node's
children, member counts and ended conversations come out of a depth-first walk of such
intersections.

A node that ends within a partition is complete there.  Only the nodes on the way to a
partition's first and last conversation go on in others; they are one summary per
partition, and the summaries are put together in order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOBODY, written

EVERY = 100  # one conversation of so many lends its opening
OPENING = 6  # openings have fewer turns than that
SHARD = 4096  # conversations with bitmaps of their own
SHARD_TURNS = 2**16
_CODE = 32  # hexadecimal digits of a turn's hash

_NOTHING = hashlib.sha256(b"").hexdigest()
_DONE, _WAITS, _NAME, _SUMMARY = range(4)  # kinds of rows between the steps
_COLUMNS = (
    "kind int, ref bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string, data binary"
)
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path, lengths`` of ``turns (conv_id, turn, role, text)``, one row per conversation.

    ``path`` holds 32 hexadecimal digits of SHA-256 for every turn, ``lengths`` the code
    points of its text.  Turns are in order of ``turn``, null first, then of their digits; a
    null role or text is empty.  Rows without ``conv_id`` are in no conversation.  Texts
    are left behind here: later steps move 36 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length in front keeps role and text apart.
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.sha2(content.cast("binary"), 256), 1, _CODE).alias("code"),
            F.length(text).alias("length"),
        ).alias("turn"),
    )
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return found.select("conv_id", F.array_join("turns.code", "").alias("path"), F.col("turns.length").alias("lengths"))


def share_openings(paths: DataFrame, every: int = EVERY, most: int = OPENING) -> DataFrame:
    """Conversations rebuilt: the first turns are those of the last conversation whose id ``every`` divides.

    How many is the crc32 of the id modulo ``most``.  A conversation with fewer lends
    all; one that is absent lends none, and the turns in their place are gone all the same.
    """
    paths = written(paths)  # read twice
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    lenders = paths.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("lender"),
        F.substring("path", 1, _CODE * (most - 1)).alias("opening"),
        F.slice("lengths", 1, most - 1).alias("opening_lengths"),
    )
    rows = paths.withColumns({"h": h, "lender": F.col("conv_id") - F.col("conv_id") % every})
    rows = rows.join(lenders, "lender", "left")
    none = F.array().cast("array<int>")
    h = F.col("h")
    return rows.select(
        "conv_id",
        F.concat(
            F.coalesce(F.substr("opening", F.lit(1), h * _CODE), F.lit("")), F.substr("path", h * _CODE + 1)
        ).alias("path"),
        F.concat(
            F.coalesce(F.slice("opening_lengths", 1, h), none), F.slice("lengths", h + 1, F.greatest(F.size("lengths"), F.lit(1)))
        ).alias("lengths"),
    )


def prefix_trie(paths: DataFrame, shard: int = SHARD, partitions: int | None = None) -> DataFrame:
    """Nodes of the trie of ``paths`` (see :func:`conversation_paths`), the root among them.

    Per node: the smallest member, depth, the parent's smallest member (null for the root),
    members, children, childless nodes in the subtree, code points saved in the subtree by
    keeping every text once, and the hash of the ids that end there, ascending, with commas.
    No conversations give no nodes, not even a root.  A path is one record; a conversation
    passes through one task whole, without its texts.  Equal conversations are spread over
    partitions by their id; only their ids, a byte or two each, come by one task, since a
    hash of a list is made in order.
    """
    keys = ["path", "conv_id"]
    paths = written(paths.select("conv_id", "path", "lengths"))
    spread = paths.repartitionByRange(partitions, *keys) if partitions else paths.repartitionByRange(*keys)
    made = written(spread.sortWithinPartitions(*keys).mapInArrow(_walker(shard), _COLUMNS))
    summaries = made.filter(F.col("kind") == _SUMMARY).repartition(1).sortWithinPartitions("ref")
    joined = written(summaries.mapInArrow(_join_summaries, _COLUMNS))
    every = made.filter(F.col("kind") != _SUMMARY).unionByName(joined)
    named = every.filter(F.col("kind") == _NAME).select("ref", F.col("conv_id").alias("known"))
    waiting = every.filter(F.col("kind") == _WAITS).drop("parent_conv_id").join(named, "ref")
    waiting = waiting.withColumnRenamed("known", "parent_conv_id")
    return every.filter(F.col("kind") == _DONE).select(*_RESULT).unionByName(waiting.select(*_RESULT))


class _Node:
    """An open node.  ``kids``, ``leaves`` and ``saved`` count complete nodes below it."""

    __slots__ = ("code", "ends", "kids", "leaves", "length", "low", "n", "number", "partial", "saved", "waiting")

    def __init__(self, code: str, length: int, partial: bool = False) -> None:
        self.code, self.length, self.partial = code, length, partial
        self.n = self.kids = self.leaves = self.saved = 0
        self.low, self.number = NOBODY, -1
        self.ends: list[np.ndarray] = []  # ids, in order, that end here
        self.waiting: list[tuple] = []  # rows of children, which lack this node's smallest member

    def absorb(self, row: tuple) -> None:
        """A complete child."""
        self.kids += 1
        self.leaves += row[4]
        self.saved += row[5]
        self.low = min(self.low, row[0])
        self.waiting.append(row)

    def row(self, depth: int, digest: str) -> tuple:
        return (self.low, depth, self.n, self.kids, self.leaves or 1, self.saved + (self.n - 1) * self.length, digest)


class _Rows:
    """Rows between the steps, gathered into batches."""

    def __init__(self) -> None:
        self.held: list[tuple] = []

    def children(self, node: _Node, ref: int | None = None) -> None:
        """The waiting children of a node: complete, or to be joined with the node's name ``ref``."""
        for low, depth, *rest in node.waiting:
            kind, parent = (_DONE, node.low) if ref is None else (_WAITS, None)
            self.held.append((kind, ref, low, depth, parent, *rest, None))
        node.waiting = []

    def root(self, row: tuple) -> None:
        self.held.append((_DONE, None, *row[:2], None, *row[2:], None))

    def name(self, ref: int, low: int) -> None:
        self.held.append((_NAME, ref, low, *[None] * 8))

    def batch(self) -> pa.RecordBatch:
        types = [pa.int32(), *[pa.int64()] * 8, pa.string(), pa.binary()]
        names = [column.split()[0] for column in _COLUMNS.split(", ")]
        columns = zip(*self.held, strict=True) if self.held else [[]] * len(types)
        columns = [pa.array(list(column), kind) for column, kind in zip(columns, types, strict=True)]
        self.held = []
        return pa.record_batch(columns, names)


def _digest(runs: Iterable[np.ndarray]) -> str:
    ids = [x for run in runs for x in run.tolist()]
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else _NOTHING


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list[int], list[list[str]], list[list[int]]]]:
    """Ids, turns and lengths of consecutive conversations; a long one may fill a shard alone."""
    ids, turns, lengths, n = [], [], [], 0
    for batch in batches:
        for conv_id, path, length in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            ids.append(conv_id)
            turns.append([path[i : i + _CODE] for i in range(0, len(path), _CODE)])
            lengths.append(length)
            n += len(length)
            if len(ids) >= most or n >= SHARD_TURNS:
                yield ids, turns, lengths
                ids, turns, lengths, n = [], [], [], 0
    if ids:
        yield ids, turns, lengths


def _walker(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(TaskContext.get().partitionId())
        for shard in _shards(batches, most):
            walk.add(*shard)
            yield walk.rows.batch()
        if walk.open:
            walk.finish()
            yield walk.rows.batch()

    return run


class _Walk:
    """The trie of one partition, shard by shard.  ``open`` is the way to the last conversation so far."""

    def __init__(self, part: int) -> None:
        self.part, self.rows, self.numbers = part, _Rows(), 0
        self.open: list[_Node] = []
        self.first: list[tuple[int, _Node]] = []  # nodes on the way to the partition's first conversation
        self.first_depth = 0

    def add(self, ids: list[int], turns: list[list[str]], lengths: list[list[int]]) -> None:
        known = np.array(ids, np.int64)
        post: dict[tuple[int, str], int] = {}  # the vertical bitmaps
        ended: dict[int, int] = {}
        for j, path in enumerate(turns):
            bit = 1 << j
            for place in enumerate(path):
                post[place] = post.get(place, 0) | bit
            ended[len(path)] = ended.get(len(path), 0) | bit
        starting = not self.open
        if starting:
            self.open = [_Node("", 0, True)]
            self.first = [(0, self.open[0])]
            self.first_depth = len(turns[0])
        shared = 0
        while shared < min(len(self.open) - 1, len(turns[0])) and self.open[shared + 1].code == turns[0][shared]:
            shared += 1
        while len(self.open) > shared + 1:
            self._close()
        kept, last = self.open, 1 << (len(ids) - 1)
        self.open = kept[:1]
        whole = (1 << len(ids)) - 1
        frames = [[whole, self._enter(kept[0], 0, whole, known, ended)]]
        while frames:
            members, rest = frames[-1]
            depth = len(frames) - 1
            if not rest:
                frames.pop()
                if members & last:
                    continue
                self._close()
                continue
            j = (rest & -rest).bit_length() - 1
            code = turns[j][depth]
            child = members & post[depth, code]
            frames[-1][1] = rest & ~child
            if j == 0 and depth + 1 < len(kept):
                node = kept[depth + 1]
            else:
                node = _Node(code, lengths[j][depth], starting and j == 0)
                if node.partial:
                    self.first.append((depth + 1, node))
            self.open.append(node)
            frames.append([child, self._enter(node, depth + 1, child, known, ended)])
        for node in self.open:
            if node.waiting:
                self.rows.children(node, self._ref(node))

    def _enter(self, node: _Node, depth: int, members: int, ids: np.ndarray, ended: dict[int, int]) -> int:
        """Counts the members; returns those that go on."""
        node.n += members.bit_count()
        here = members & ended.get(depth, 0)
        if here:
            start = (here & -here).bit_length() - 1
            run = ids[start : start + here.bit_count()]  # equal conversations stand together
            node.ends.append(run)
            node.low = min(node.low, int(run.min()))
        return members & ~here

    def _ref(self, node: _Node) -> int:
        if node.number < 0:
            node.number, self.numbers = self.numbers, self.numbers + 1
        return self.part << 32 | node.number

    def _close(self) -> None:
        """The deepest open node gets no more members in this partition."""
        node = self.open.pop()
        if node.partial:
            if node.waiting:
                self.rows.children(node, self._ref(node))
            return
        self.rows.children(node)
        if node.number >= 0:
            self.rows.name(self._ref(node), node.low)
        self.open[-1].absorb(node.row(len(self.open), _digest(node.ends)))

    def finish(self) -> None:
        """The summary: nodes of the first and the last way, parents before children."""
        way = [(depth, node) for depth, node in enumerate(self.open) if not node.partial]
        records, runs = [], []
        for depth, node in [*self.first, *way]:
            # Only the ids that end with the first or the last conversation may go on elsewhere.
            if (depth == self.first_depth and node.partial) or depth == len(self.open) - 1 and node is self.open[-1]:
                ends = sum(len(run) for run in node.ends)
                runs += node.ends
            else:
                ends = _digest(node.ends)
            number = node.number if node.number < 0 else self._ref(node)
            low = None if node.low == NOBODY else node.low
            records.append([depth, node.code, node.length, node.n, low, node.kids, node.leaves, node.saved, number, ends])
        ids = np.concatenate([np.zeros(0, np.int64), *runs])
        head = json.dumps(records).encode()
        data = len(head).to_bytes(8, "little") + head + pa.compress(np.diff(ids, prepend=0).tobytes(), "zstd", asbytes=True)
        count = len(ids)
        self.rows.held.append((_SUMMARY, self.part, count, *[None] * 7, data))


def _join_summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the open nodes of all partitions together, in the order of the partitions."""
    rows, way = _Rows(), []

    def close() -> None:
        node, hashed, names = way.pop()
        rows.children(node)
        for ref in names:
            rows.name(ref, node.low)
        done = node.row(len(way), hashed if isinstance(hashed, str) else hashed.hexdigest())
        if way:
            way[-1][0].absorb(done)
        else:
            rows.root(done)

    for batch in batches:
        for count, data in zip(batch.column(2).to_pylist(), batch.column(10).to_pylist(), strict=True):
            size = int.from_bytes(data[:8], "little")
            ids = np.cumsum(np.frombuffer(pa.decompress(data[8 + size :], 8 * count, "zstd", asbytes=True), np.int64))
            for depth, code, length, n, low, kids, leaves, saved, ref, ends in json.loads(data[8 : 8 + size]):
                if len(way) > depth and way[depth][0].code != code:
                    while len(way) > depth:
                        close()
                if len(way) == depth:
                    way.append([_Node(code, length), _NOTHING, []])
                node, hashed, names = way[depth]
                node.n += n
                node.kids += kids
                node.leaves += leaves
                node.saved += saved
                if low is not None:
                    node.low = min(node.low, low)
                if ref >= 0:
                    names.append(ref)
                if isinstance(ends, str):
                    if ends != _NOTHING:
                        way[depth][1] = ends
                elif ends:
                    text = ",".join(map(str, ids[:ends].tolist()))
                    if isinstance(hashed, str):
                        way[depth][1] = hashlib.sha256(text.encode())
                    else:
                        hashed.update(f",{text}".encode())
                    ids = ids[ends:]
        yield rows.batch()
    while way:
        close()
    yield rows.batch()
