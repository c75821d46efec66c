"""Near-duplicates: MinHash bands, odd sketches, and exact confirmation on full sets.

1. The set of word shingles of every text gives MinHash values; rows of them make band
   keys, and all of them are folded into an odd sketch, a bitmap of parities.  Texts of the
   same set are one node from here on.
2. Nodes with a common band key are candidates.  The population count of the XOR of two
   sketches estimates their similarity; within a key, nodes are joined to leaders that are
   roughly like them, so that a key of many nodes gives about one edge per node.  Texts
   over the threshold end up in one component of these edges.
3. Inside such a component all links are found on the full sets.  A large component is cut
   into chunks of bounded size, each searched on its own.  One central text then visits
   all chunks, and what is still apart from it visits all chunks as well.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, bounded_batches, groups, lower_bytes, mixed, word_hashes, written
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 6  # a pair at 0.8 shares no band in 5 of a million cases
_BITS = 1024  # of a sketch
_COVERED, _LIKE = 0.6, 0.2  # estimates from which a leader stands for a node, and is joined to it
_CHUNK = 2**20  # shingles of a chunk
_SLICE = 2**22
_NODES = 4096  # nodes whose common keys are found before the shuffle

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_KEYS = _random.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32)


# Signatures ---------------------------------------------------------------


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words than one has, the whole sequence is one."""
    words = word_hashes(lower_bytes(text.encode()))
    if not len(words):
        return words
    width = min(size, len(words))
    value = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(value)])
    return np.unique(value)


def min_hashes(found: np.ndarray) -> np.ndarray:
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    for start in range(0, len(short), 4096):
        np.minimum(least, (short[start : start + 4096, None] * _FACTORS).min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """Parities of how many MinHash values fall on each bit."""
    bits = mixed(least.astype(np.uint64) + _PLACES) % np.uint64(_BITS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=_BITS) & 1).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row: from the bits in which they differ."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    free = np.maximum(1 - 2 * differ / _BITS, 1e-9)
    return 1 + _BITS / (4 * len(_FACTORS)) * np.log(free)


def _signed(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, _SLICE):
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, size)
                n.append(len(found))
                if not len(found):
                    digest.append(None), bands.append(None), sketch.append(None)
                    continue
                least = min_hashes(found)
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _KEYS).sum(axis=1, dtype=np.uint64)
                bands.append(mixed(keys + np.arange(BANDS, dtype=np.uint64)).tobytes())
                sketch.append(odd_sketch(least))
            columns = [pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, bands, sketch))]
            names = ["row", "doc_id", "n", "digest", "bands", "sketch"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)

    return run


# Candidates ---------------------------------------------------------------


def lead(group: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders within groups of rows: which rows lead, and edges from leaders to rows like them.

    ``group`` is in rising order.  In a round the first row of each group that no leader
    stands for leads; all rows of its group that are like it are joined to it.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    leads = np.zeros(len(group), bool)
    open_ = np.ones(len(group), bool)
    leads[starts[sizes == 1]] = True
    rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
    froms, tos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows):
        own = group[rows]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, len(rows)])
        waiting = np.where(open_[rows], rows, len(group))
        leader = np.minimum.reduceat(waiting, first)
        active = leader < len(group)
        rows, leader = rows[np.repeat(active, size)], np.repeat(leader[active], size[active])
        if not len(rows):
            break
        leads[leader] = True
        alike = estimate(sketches[rows], sketches[leader])
        joined = (alike >= _LIKE) & (rows != leader)
        froms.append(leader[joined])
        tos.append(rows[joined])
        open_[rows[(alike >= _COVERED) | (rows == leader)]] = False
    return leads, np.concatenate(froms), np.concatenate(tos)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes: from the smallest node of each component to its others."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[others]], nodes[others]


_EDGE = ["key", "node", "other", "sketch"]


def _bucket_rows(keys, nodes, sketches, froms, tos) -> pa.RecordBatch:
    """Leaders with their key, and edges: rows without a key."""
    n, m = len(keys), len(froms)
    view = [x.tobytes() for x in sketches]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[keys.view(np.int64), np.zeros(m, np.int64)], mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
            pa.array(np.r_[nodes, froms]),
            pa.array(np.r_[np.zeros(n, np.int64), tos], mask=np.r_[np.ones(n, bool), np.zeros(m, bool)]),
            pa.array([*view, *[None] * m], pa.binary()),
        ],
        _EDGE,
    )


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _BITS // 64)


def _local_leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of nodes; of nodes of a slice with a common key only the leaders go on."""
    for whole in batches:
        for start in range(0, whole.num_rows, _NODES):
            batch = whole.slice(start, _NODES)
            node = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            sketch = _sketches(batch.column(2))
            owner = np.repeat(np.arange(len(node)), BANDS)
            order = np.lexsort((mixed(keys ^ node[owner].astype(np.uint64)), keys))
            keys, owner = keys[order], owner[order]
            _, group = np.unique(keys, return_inverse=True)
            leads, froms, tos = lead(group, sketch[owner])
            kept = owner[leads]
            edges = spanning(node[owner[froms]], node[owner[tos]])
            yield _bucket_rows(keys[leads], node[kept], sketch[kept][:, :0], *edges)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has more than one."""
    last_key, last_row, given = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last_row is not None:
            keys, nodes = np.r_[last_key, keys], np.r_[last_row, nodes]
        same = keys[1:] == keys[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        # The last row waits for the next batch, unless it is given already.
        begin = 1 if last_row is not None and given else 0
        chosen = np.flatnonzero(keep)
        chosen = chosen[chosen >= begin]
        given = bool(keep[-1]) if len(keys) > 1 else False
        last_key, last_row = keys[-1], nodes[-1]
        yield pa.record_batch([pa.array(keys[chosen]), pa.array(nodes[chosen])], ["key", "node"])


def _global_leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups_of_keys(batches):
        keys, node = batch["key"].to_numpy(), batch["node"].to_numpy()
        sketch = _sketches(batch["sketch"])
        _, group = np.unique(keys, return_inverse=True)
        _, froms, tos = lead(group, sketch)
        yield pa.record_batch([pa.array(x) for x in spanning(node[froms], node[tos])], ["a", "b"])


def groups_of_keys(batches: Iterable[pa.RecordBatch], size: int = 50_000) -> Iterator[pa.Table]:
    """Whole groups of rows with one key, many groups at once."""
    held, n = [], 0
    for table in groups(batches, 1):
        held.append(table)
        n += table.num_rows
        if n >= size:
            yield pa.concat_tables(held)
            held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) such that nodes over the threshold are connected by them."""
    schema = "key bigint, node bigint, other bigint, sketch binary"
    local = written(nodes.select("node", "bands", "sketch").mapInArrow(_local_leaders, schema))
    inner = local.filter("key is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    keyed = local.filter("key is not null").select("key", "node")
    shared = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key bigint, node bigint")
    # Only rows of keys that several leaders share need their sketches.
    met = shared.join(nodes.select("node", "sketch"), "node").select("key", "node", "sketch")
    mix = F.xxhash64("key", "node")
    met = met.withColumn("mix", mix).repartition("key").sortWithinPartitions("key", "mix")
    outer = met.mapInArrow(_global_leaders, "a bigint, b bigint")
    return inner.unionByName(outer)


# Confirmation -------------------------------------------------------------


class Sets:
    """Shingle sets of some texts, laid out so that many pairs are compared at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, place, often = np.unique(every, return_inverse=True, return_counts=True)
        common = often > 1
        column = np.cumsum(common) - 1
        kept = common[place]
        self.width = int(common.sum())
        self.central = np.bincount(owner, often[place], len(sets)) / self.size
        self.sets = sets
        # Shingles of one text alone are in no intersection; the others are bits.
        self.bits = None
        if len(sets) * self.width <= 2**29:
            dense = np.zeros((len(sets), -(-self.width // 64) * 8), np.uint8)
            at = column[place[kept]]
            np.bitwise_or.at(dense, (owner[kept], at >> 3), (1 << (at & 7)).astype(np.uint8))
            self.bits = dense.view(np.uint64)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others are linked with text i."""
        low, high = self.size[i] * percent, self.size[others] * 100
        near = (high >= low) & (self.size[others] * percent <= self.size[i] * 100)
        result = np.zeros(len(others), bool)
        at = others[near]
        if self.bits is not None:
            shared = np.bitwise_count(self.bits[at] & self.bits[i]).sum(axis=1, dtype=np.int64)
        else:
            shared = np.array([len(np.intersect1d(self.sets[i], self.sets[j], True)) for j in at], np.int64)
        result[near] = 100 * shared >= percent * (self.size[i] + self.size[at] - shared)
        return result


def clusters(sets: Sets, percent: int) -> np.ndarray:
    """Connected components by links: every text once looks for links among those not reached."""
    label = np.full(len(sets.size), -1)
    rest = np.argsort(-sets.central, kind="stable")
    while len(rest):
        start, rest = rest[0], rest[1:]
        label[start] = start
        queue = [start]
        while queue and len(rest):
            found = sets.linked(queue.pop(), rest, percent)
            queue.extend(rest[found])
            label[rest[found]] = start
            rest = rest[~found]
    return label


def _texts_to_sets(texts: list[str], size: int) -> list[np.ndarray]:
    return [shingles(text, size) for text in texts]


_FOUND = "comp bigint, chunk int, node bigint, cluster bigint, central double, n bigint"


def _local_clusters(size: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            node = table["node"].to_numpy()
            sets = Sets(_texts_to_sets(table["text"].to_pylist(), size))
            label = clusters(sets, percent)
            columns = [table["comp"], table["chunk"], node, node[label], sets.central, sets.size]
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["comp", "chunk", "node", "cluster", "central", "n"])

    return run


def _visits(size: int, percent: int):
    """Links between the clusters of visitors and those of a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            visitor = table["visitor"].to_numpy(zero_copy_only=False)
            cluster = table["cluster"].to_numpy()
            if visitor.all() or not visitor.any():
                continue
            sets = Sets(_texts_to_sets(table["text"].to_pylist(), size))
            home = np.flatnonzero(~visitor)
            links = set()
            for i in np.flatnonzero(visitor):
                known = [b for a, b in links if a == cluster[i]] + [cluster[i]]
                at = home[~np.isin(cluster[home], known)]
                links.update((int(cluster[i]), int(c)) for c in np.unique(cluster[at[sets.linked(i, at, percent)]]))
            found = np.array(sorted(links), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _visit(chunks: DataFrame, visitors: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that ``visitors (comp, block, cluster, text)`` have in any chunk of their component."""
    homes = chunks.select("comp", "chunk").distinct()
    blocks = visitors.select("comp", "block").distinct()
    columns = ["comp", "chunk", "block", "visitor", "cluster", "text"]
    coming = visitors.select("comp", "block", "cluster", "text").join(homes, "comp").withColumn("visitor", F.lit(True)).select(*columns)
    staying = chunks.join(blocks, "comp").withColumn("visitor", F.lit(False)).select(*columns)
    met = coming.unionByName(staying).repartition("comp", "chunk", "block")
    return met.sortWithinPartitions("comp", "chunk", "block").mapInArrow(_visits(size, percent), "a bigint, b bigint")


def _confirmed(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, root`` by exact links inside each component of candidates.

    ``members`` has ``row, node, n, comp``; ``texts`` has ``row, text``.
    """
    weight = members.groupBy("comp").agg(F.ceil(F.sum("n") / _CHUNK).cast("int").alias("chunks"))
    placed = members.join(weight, "comp")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # Sorted on both sides at every size: candidates are a share of the texts, so none is sent to all.
    rows = placed.join(texts.hint("merge"), "row").select("comp", "chunk", "chunks", "node", "text")
    work = rows.repartition("comp", "chunk").sortWithinPartitions("comp", "chunk")
    one = work.select("comp", "chunk", "node", "text").mapInArrow(_local_clusters(size, percent), _FOUND)
    found = written(one.join(placed.select("node", "chunks", "row"), "node"))
    whole = found.filter("chunks = 1").select("node", F.col("cluster").alias("root"))
    many = found.filter("chunks > 1")
    if many.isEmpty():
        return whole
    # Components of several chunks.
    chunks = written(many.join(texts.hint("merge"), "row").select("comp", "chunk", "node", "cluster", "central", "n", "text"))
    pivot = F.max(F.struct("central", "node"))["node"]
    pivots = chunks.join(chunks.groupBy("comp").agg(pivot.alias("node")), ["comp", "node"])
    first = written(_visit(chunks, pivots.withColumn("block", F.lit(0)), size, percent))
    # Clusters that the central text does not reach look for links everywhere.
    reached = first.select(F.col("b").alias("cluster")).unionByName(pivots.select("cluster")).distinct()
    apart = chunks.join(reached, "cluster", "left_anti")
    blocks = apart.groupBy("comp").agg(F.ceil(F.sum("n") / _CHUNK).alias("blocks"))
    apart = apart.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    links = first.unionByName(_visit(chunks, apart, size, percent))
    roots = components(links)
    joined = many.select("node", "cluster").join(roots.withColumnRenamed("node", "cluster"), "cluster", "left")
    return whole.unionByName(joined.select("node", F.coalesce("root", "cluster").alias("root")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """Components of texts linked by ``100 * shared shingles >= percent * all shingles`` of two texts.

    Words stand between white space, A-Z in lower case; a shingle is ``size`` words, and a
    text of fewer words is one shingle.  A text without words, a null one too, has none and
    is linked with nothing.  One row per input row: ``row`` (the column ``row`` of a
    table whose rows have fixed numbers, or a number in the order of this scan), ``doc_id, n_shingles, component_id`` (smallest id of the component, of a text
    without links its own), ``kept`` (whether it is that one) and ``first`` (true for one
    row of each component, also where ids are null or repeat).

    A link is found if its two texts share a band, which those at the threshold miss in 5
    of a million cases and more similar ones in fewer; found links are exact.
    """
    texts = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    if not row:
        # Written, since another scan might be cut otherwise and number its rows anew.
        texts = written(texts)
    fields = "row bigint, doc_id bigint, n bigint, digest binary, bands binary, sketch binary"
    signed = written(texts.mapInArrow(_signed(size), fields))
    sets = signed.filter("n > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = written(sets)
    comp = components(candidates(nodes)).withColumnRenamed("root", "comp")
    members = written(nodes.join(comp, "node").select(F.col("node").alias("row"), "node", "n", "comp"))
    roots = _confirmed(texts.select("row", "text"), members, size, percent)
    classes = nodes.select("digest", "node").join(roots, "node", "left")
    classes = classes.select("digest", F.coalesce("root", "node").alias("class"))
    # Texts without words are classes of their own.
    lone = signed.filter("n = 0").select("row", "doc_id", "n", F.col("row").alias("class"))
    rows = signed.filter("n > 0").join(classes, "digest").select("row", "doc_id", "n", "class").unionByName(lone)
    rows = written(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row"))
    # Written, so that the join below deals out both sides itself and can split a large class.
    best = written(rows.groupBy("class").agg(first.alias("best")))
    return rows.join(best, "class").select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("best.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("best.doc_id"), F.col("row") == F.col("best.row")).alias("kept"),
        (F.col("row") == F.col("best.row")).alias("first"),
    )
