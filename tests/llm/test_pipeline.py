"""The stages one after the other, each against what it should have kept."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barometry.llm.common import words_of
from barometry.llm.quality import score_quality
from barometry.sources.store import shared_folder

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, FOLDER)
    accepted = {r.doc_id for r in score_quality(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted and good.columns == docs.columns

    single = stages["exact_dedup"](spark, docs, FOLDER).collect()
    texts = {plain(r.text) for r in docs.collect()}
    assert {plain(r.text) for r in single} == texts and len(single) == len(texts)

    near = stages["near_dedup"](spark, docs, FOLDER).collect()
    assert set(near) <= set(docs.collect())

    def shingles(text):
        words = words_of(text)
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = [s for s in (shingles(r.text) for r in near) if s]
    for i, a in enumerate(sets):
        assert not any(len(a & b) * 100 >= 80 * len(a | b) for b in sets[:i])

    clean = stages["decontamination"](spark, docs, FOLDER).collect()
    gone = set(docs.collect()) - set(clean)

    def holds(text):
        words = words_of(text)
        return any(words[i : i + len(item)] == item for item in items for i in range(len(words)))

    assert {r for r in docs.collect() if holds(r.text)} <= gone
    assert len(gone) <= 10


def test_whole_run_packs_what_is_left(spark):
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert len({r.doc_id for r in packed}) > 100
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed[0].asDict())


def plain_stages(docs):
    """What the stages for copies keep, by brute force: texts equal, then linked by their shingles."""
    best = {}
    for row in docs:
        key = plain(row.text)
        rank = (-len(row.text or ""), row.doc_id is None, row.doc_id or 0)
        if key not in best or rank < best[key]:
            best[key] = rank
    return sorted(best)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, nothing, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, nothing, FOLDER).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_awkward_rows_and_clashing_names(spark, corpus, stage):
    """Rows are kept whole, whatever further columns are called; nulls and repeated rows have a defined result."""
    docs, _ = corpus
    names = ["row", "_row", "__row", "kept", "first", "ROW2", "item_id"]
    docs = docs.withColumns({name: F.concat(F.lit(name), F.coalesce("text", F.lit("null"))) for name in names})
    result = dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
    assert result.columns == docs.columns
    before, after = Counter(docs.collect()), Counter(result.collect())
    assert not after - before
    if stage == "exact_dedup":
        assert sorted(plain(r.text) for r in after.elements()) == plain_stages(before.elements())
    if stage == "near_dedup":
        # Every text that is gone is linked with one that stays, directly or over others.
        stays = [shingles(r.text) for r in after.elements()]
        assert sum(not x for x in stays) == sum(not shingles(r.text) for r in before.elements())
        for a, b in itertools.combinations([x for x in stays if x], 2):
            assert len(a & b) * 100 < 80 * len(a | b)
    if stage == "decontamination":
        items = [words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
        holds = lambda words: any(words[i : i + len(x)] == x for x in items for i in range(len(words)))
        assert not any(holds(words_of(r.text or "")) for r in after)
        assert sum(after.values()) >= sum(before.values()) - 10


def shingles(text):
    words = words_of(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_run_leaves_only_its_last_input(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    corpus_pipeline.run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    # The documents that are packed, and what packing has written.
    assert len(set(folder.glob("*")) - before) <= 3
