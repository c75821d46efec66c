from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barometry.llm import suffix_dedup
from barometry.llm.suffix_dedup import LENGTH, remove_repeats, smallest_owners


def removed(rows):
    """By trying every string of every text."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        data = text.encode()
        for p in range(len(data) - LENGTH + 1):
            string = data[p : p + LENGTH]
            first[string] = min(first.get(string, (True, 1)), order(i))
    result = []
    for i, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - LENGTH + 1):
            if first[data[p : p + LENGTH]] < order(i):
                gone[p : p + LENGTH] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        result.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return result


@pytest.mark.parametrize("hot", [2000, 2])
def test_removes_what_earlier_documents_hold(corpus, monkeypatch, hot):
    docs, rows = corpus
    monkeypatch.setattr(suffix_dedup, "_HOT", hot)
    found = remove_repeats(docs)
    assert Counter(map(tuple, found.drop("removed").collect())) == Counter(removed(rows))


def test_index_finds_every_equal_string():
    rng = random.Random(5)
    for _ in range(20):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 81))) for _ in range(4)]
        contents = list({b[: rng.randrange(50, len(b) + 1)] for b in base for _ in range(3)} | {b"a" * 60})
        docs = np.array([rng.randrange(100) for _ in contents])
        least = {}
        for content, doc in zip(contents, docs, strict=True):
            for p in range(len(content) - LENGTH + 1):
                string = content[p : p + LENGTH]
                least[string] = min(least.get(string, 100), doc)
        expected = [[least[c[p : p + LENGTH]] for p in range(len(c) - LENGTH + 1)] for c in contents]
        assert [list(x) for x in smallest_owners(contents, docs)] == expected


def test_later_rounds_sort_only_what_ties(monkeypatch):
    rng = random.Random(6)
    contents = [bytes(rng.choices(b"abcdefgh", k=70)) for _ in range(60)]
    contents += [contents[0][:69] + b"z", contents[1][1:]]
    sizes = np.array([len(c) + 1 for c in contents])
    ends = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    number = np.repeat(np.arange(len(contents)), sizes)
    sorted_, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sorted_.append(len(a)) or argsort(a, *args, **kw))
    order = suffix_dedup.suffix_array(symbols, number, ends[number] - np.arange(len(symbols)))
    assert len(sorted_) > 2 and sum(sorted_) < 2 * len(symbols)
    # An end sorts before all bytes, and ends like their stretches.
    suffix = [(*symbols[p : ends[i]].tolist(), 0, int(i)) for p, i in enumerate(number)]
    assert order.tolist() == sorted(range(len(symbols)), key=suffix.__getitem__)


def test_spans_are_given(spark):
    same = "0123456789" * 6
    docs = spark.createDataFrame([(1, same), (2, "before" + same + "after")], "doc_id long, text string")
    assert remove_repeats(docs).filter("doc_id = 2").first()["removed"] == [[6, 66]]
