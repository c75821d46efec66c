from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from barometry.llm import near_dedup
from barometry.llm.common import words_of
from barometry.llm.components import components
from barometry.llm.near_dedup import estimate, min_hashes, near_duplicates, odd_sketch, spanning


def brute_force(rows, size):
    sets = []
    for _, text in rows:
        words = words_of(text)
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(b)] = find(a)
    best = {}
    order = lambda i: (i is None, i or 0)
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, 1)), order(i))
    return Counter((i, len(sets[k]), None if best[find(k)][0] else best[find(k)][1]) for k, (i, _) in enumerate(rows))


@pytest.fixture(scope="module")
def copies(spark, corpus):
    """The corpus, and a group of edited copies whose members mostly are linked through others."""
    docs, rows = corpus
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    more = []
    for i in range(40):
        own = list(base)
        for k in rng.sample(range(120), rng.choice([3, 6, 9, 12])):
            own[k] = f"e{rng.randrange(10**6)}"
        more.append((5000 + i, " ".join(own)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).coalesce(3)
    return both, rows + more


@pytest.mark.parametrize(("size", "chunk"), [(2, 2**20), (2, 400), (5, 2**20)])
def test_components_are_those_of_all_pairs(copies, monkeypatch, size, chunk):
    docs, rows = copies
    monkeypatch.setattr(near_dedup, "_CHUNK", chunk)
    found = near_duplicates(docs, size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_force(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)
    assert sum(r["first"] for r in found) >= len({r.component_id for r in found})


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for wanted in (0.7, 0.8, 0.9, 0.95):
        shared = rng.integers(0, 2**63, int(2000 * wanted)).astype(np.uint64)
        rest = rng.integers(0, 2**63, (2, 1000 - int(1000 * wanted))).astype(np.uint64)
        a, b = (odd_sketch(min_hashes(np.unique(np.r_[shared, own]))) for own in rest)
        assert abs(estimate(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) - wanted) < 0.1


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 60), (61, 60), (70, 70), (60, 50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50, 61: 50}


def test_spanning_edges_connect_the_same_nodes():
    a, b = np.array([5, 5, 9, 3, 20, 7]), np.array([9, 3, 3, 9, 21, 7])
    assert set(zip(*(x.tolist() for x in spanning(a, b)), strict=True)) == {(3, 5), (3, 9), (20, 21)}
