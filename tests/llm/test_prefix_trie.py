"""The trie of conversations against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from barometry.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def code(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def ordered(rows):
    found = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            found.setdefault(conv_id, []).append((turn, role or "", text or ""))
    key = lambda t: (t[0] is not None, t[0] or 0, code(*t[1:]))
    return {c: [t[1:] for t in sorted(turns, key=key)] for c, turns in found.items()}


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = conversations.get(lender, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    ends = {}
    for c, turns in conversations.items():
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + own)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ids.encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), *totals[node], digest))
    return sorted(out, key=str)


def found_by(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def made_up(seed, n):
    """Few different turns, so that most openings are shared; copies, gaps, nulls and long ones."""
    random.seed(seed)
    rows = []
    for c in range(n):
        if c % 7 == 3:
            continue
        length = random.choice([1, 1, 2, 3, 4, 6, 40])
        same = random.random() < 0.3
        for t in range(length):
            text = f"t{t}" if same else f"t{random.randint(0, 2)}"
            rows.append((c, t if random.random() < 0.9 else None, random.choice(["user", "assistant", None]) if not same else "user", text if t % 5 else None))
    rows += [(None, 1, "user", "nobody"), (5, 1, "user", "again"), (5, 1, "user", "again"), (-150, 0, "user", "ä😀"), (-100, 2, "system", "b")]
    return rows


@pytest.mark.parametrize(("seed", "n", "shard", "partitions"), [(1, 300, 4096, 1), (2, 300, 5, 7), (3, 200, 1, 40), (4, 350, 16, 3)])
def test_equals_a_trie_built_turn_by_turn(spark, seed, n, shard, partitions):
    rows = made_up(seed, n)
    paths = trie.conversation_paths(spark.createDataFrame(rows, SCHEMA))
    conversations = ordered(rows)
    assert found_by(trie.prefix_trie(paths, shard, partitions)) == plain_trie(conversations)
    shared = trie.share_openings(paths)
    assert found_by(trie.prefix_trie(shared, shard, partitions)) == plain_trie(rebuilt(conversations))


def test_group_of_copies_over_partitions_has_one_list_of_ids(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(500) for t in range(3)] + [(900, 0, "user", "same 0")]
    paths = trie.conversation_paths(spark.createDataFrame(rows, SCHEMA))
    made = trie.prefix_trie(paths, 16, 9)
    assert found_by(made) == plain_trie(ordered(rows))


def test_empty_table_and_clashing_names(spark):
    assert trie.prefix_trie(trie.conversation_paths(spark.createDataFrame([], SCHEMA))).collect() == []
    names = ["path", "lengths", "kind", "ref", "h", "lender", "code", "depth", "data"]
    rows = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA).withColumns({name: F.lit("y") for name in names})
    made = trie.prefix_trie(trie.share_openings(trie.conversation_paths(rows)))
    assert found_by(made) == plain_trie(rebuilt({1: [("user", "x")]}))


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    only = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 1)
    paths = trie.conversation_paths(spark.createDataFrame([(only, 0, "user", "x")], SCHEMA))
    digest = hashlib.sha256(str(only).encode()).hexdigest()
    assert found_by(trie.prefix_trie(trie.share_openings(paths))) == [(only, 0, None, 1, 0, 1, 0, digest)]
