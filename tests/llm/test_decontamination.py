from __future__ import annotations

import random

import numpy as np

from barometry.llm import decontamination
from barometry.llm.decontamination import GAP, MATCH, MISMATCH, align, find_contamination


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH)
            h[i, j] = max(0, step, h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return h.max()


def test_alignment_is_the_best_one():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, first, last = align(a, b)
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[first : last + 1]) == score


def test_edited_copies_are_found_and_others_left_alone(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("al", "en", "ir", "os", "un")]
    item = lambda: " ".join(rng.choice(words) for _ in range(30))
    items = [(i, item()) for i in range(40)]
    docs, copies = [], set()
    for i, (item_id, text) in enumerate(items):
        edited = text.split()
        for k in rng.sample(range(30), 6):
            edited[k] = "other"
        docs.append((i, f"{item()} {' '.join(edited)} {item()}"))
        copies.add((i, item_id))
        docs.append((1000 + i, f"{item()} {item()}"))
    docs += [(None, None), (3000, ""), (3001, items[0][1].upper()), (3001, items[0][1])]
    schema = "doc_id long, text string"
    benchmark = spark.createDataFrame([*items, items[0], (77, None), (78, "two words"), (79, ""), (None, None)], "item_id long, text string")
    for block in (decontamination._BLOCK, 300):  # in one pass, and in several
        monkeypatch.setattr(decontamination, "_BLOCK", block)
        found = [tuple(r)[:3] for r in find_contamination(spark.createDataFrame(docs, schema), benchmark).collect()]
        assert {(d, i) for d, i, _ in found if d < 3000} == copies
        assert sorted(f for f in found if f[0] >= 3000) == [(3001, 0, 1.0), (3001, 0, 1.0)]


def test_short_and_unspaced_items_are_found(spark):
    docs = [(1, "The exact Two-Words here"), (2, "two other words"), (3, "Single!"), (4, "\u524d\u6587\u5b57\u7684\u4e00\u4e2a\u957f\u957f\u53e5\u5b50\u540e\u6587"), (5, "two words two words")]
    items = [(7, "two words"), (8, "single"), (9, "\u5b57\u7684\u4e00\u4e2a\u957f\u957f\u53e5\u5b50")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted(tuple(r) for r in find_contamination(docs, items).collect())
    assert found == [(1, 7, 1.0, 2, 3), (3, 8, 1.0, 0, 0), (4, 9, 1.0, 2, 9), (5, 7, 1.0, 0, 1)]
    assert [r.doc_id for r in decontamination.keep_clean(docs, items).collect()] == [2]


def test_copies_of_eight_words_with_many_edits(spark):
    """Recall over all copies that score enough, with words replaced, dropped or put in between."""
    rng = random.Random(5)
    words = [f"u{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(8)] for _ in range(30)]
    table = decontamination.Items.of([(i, " ".join(item)) for i, item in enumerate(items)])
    present = np.zeros(len(table.vocabulary) + 1, bool)
    wanted = found = 0
    for i, item in enumerate(items * 20):
        copy = list(item)
        for at in rng.sample(range(8), 3):
            copy[at] = rng.choice([f"x{i}", "", f"{copy[at]} y{i}"])
        text = " ".join(["far", *copy, "off"])
        code = {w: k for k, w in enumerate({*item, *text.split()})}
        score = smith_waterman(*([code[w] for w in x] for x in (item, text.split())))
        if score >= decontamination.THRESHOLD * MATCH * 8:
            wanted += 1
            found += any(x[0] == i % 30 and x[1] == score / (MATCH * 8) for x in decontamination.copies(text, table, decontamination.THRESHOLD, present))
    assert wanted > 400 and found == wanted


def test_every_third_word_replaced_is_found(spark):
    item = [f"w{i}" for i in range(24)]
    copy = ["x" if i % 3 == 2 else word for i, word in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(copy))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [r.score for r in find_contamination(docs, benchmark).collect()] == [(16 * 2 - 7) / 48]


def test_rows_are_kept_as_they_are_in_blocks_too(spark, monkeypatch, corpus):
    docs, _ = corpus
    items = docs.filter("doc_id < 3").selectExpr("doc_id as item_id", "text")
    dropped = {r.doc_id for r in find_contamination(docs.filter("doc_id is not null"), items).collect()}
    expected = sorted((tuple(r) for r in docs.collect() if r.doc_id not in dropped), key=str)
    for block in (decontamination._BLOCK, 300):
        monkeypatch.setattr(decontamination, "_BLOCK", block)
        kept = decontamination.keep_clean(docs, items)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == expected
    assert len(dropped) >= 2


def test_the_only_grams_that_edits_leave_are_seeds(spark):
    """Two intact 3-grams among ten; the others occur nowhere in the corpus."""
    item = [f"w{i}" for i in range(12)]
    copy = ["x" if i in (3, 6, 10) else word for i, word in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["far", *copy, "away"]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in find_contamination(docs, benchmark).collect()] == [(1, 5, 0.625, 1, 12)]


def test_short_heavily_edited_items_against_all_alignments(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randint(3, 14))] for _ in range(25)]
    docs = []
    for i, item in enumerate(items * 4):
        copy = []
        for word in item:
            kind = rng.random()
            copy += [word] if kind < 0.55 else [f"e{i}"] if kind < 0.75 else [] if kind < 0.85 else [word, *["y"] * rng.randint(1, 9)]
        docs.append([*["far"] * rng.randint(0, 5), *copy, *rng.sample(words, 4)])
    number = {}
    code = lambda text: np.array([number.setdefault(word, len(number)) for word in text])
    expected = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            score = smith_waterman(code(item), code(doc)) / (MATCH * len(item))
            if score >= decontamination.THRESHOLD:
                expected[d, i] = score
    assert len(expected) > 40 and min(expected.values()) < 0.5
    rows = spark.createDataFrame([(d, " ".join(doc)) for d, doc in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    assert {(d, i): score for d, i, score, *_ in find_contamination(rows, benchmark).collect()} == expected
