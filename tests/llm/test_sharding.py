from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from barometry.llm.sharding import place, shard_documents


def test_sizes_checksums_and_slots(corpus):
    docs, rows = corpus
    found = shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r.shard for r in found if r.doc_id == i}) == 1 for i in (None, 1006, 1007))


def test_shards_are_won_by_weight_and_keep_their_records(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = place(docs, 4, [1, 1, 2, 4, 2]).collect()
    won = Counter(r.shard for r in rows)
    assert all(abs(won[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate([1, 1, 2, 4]))
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {4} and abs(len(moved) / 20_000 - 0.2) < 0.02
    again = {r.doc_id: r.shard for r in place(docs, 5, [1, 1, 2, 4, 2, 1]).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)


def test_weights_are_checked(spark):
    with pytest.raises(ValueError, match="one positive weight"):
        place(spark.range(1).withColumnRenamed("id", "doc_id"), 3, [1, 1, 1])


def test_ids_at_both_ends_of_the_range(spark):
    ids = [-(2**63), -(2**63) + 1, -1, 0, 2**63 - 2, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in ids] * 2, "doc_id long, text string")
    found = shard_documents(docs, shards=3, slices=5).collect()
    assert sorted(r.doc_id for r in found) == sorted(ids * 2)
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
