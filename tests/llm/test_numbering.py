"""Tables whose scans are cut otherwise in each job, as when executors are lost or join."""

from __future__ import annotations

import itertools

import pytest

import corpus_pipeline
from barometry.llm import common, components, exact_dedup, near_dedup, pitman_yor, suffix_dedup

FOLDER = "/root/testdata/sf0.001"
RUNS = {
    "op2": lambda s, d: suffix_dedup.remove_repeats(d),
    "op5": lambda s, d: near_dedup.near_duplicates(d, size=2).drop("row", "first"),
    "op9": lambda s, d: pitman_yor.score_texts(d),
    "exact": lambda s, d: corpus_pipeline.without_copies(s, d, FOLDER),
    "near": lambda s, d: corpus_pipeline.without_near_copies(s, d, FOLDER),
    "benchmark": lambda s, d: corpus_pipeline.without_benchmark(s, d, FOLDER),
}
SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('cut')}/documents.parquet"
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    docs = docs.unionByName(docs.limit(60))
    docs.repartition(5, "doc_id").write.parquet(path)
    return path


@pytest.mark.parametrize("name", RUNS)
def test_rows_keep_their_numbers(spark, table, monkeypatch, name):
    read = lambda: sorted(map(str, RUNS[name](spark, spark.read.parquet(table)).collect()))
    expected = read()
    before, turn = spark.conf.get(SPLITS), itertools.cycle(["4k", "1g"])
    kept = common.written

    def cut_anew(df):
        result = kept(df)
        spark.conf.set(SPLITS, next(turn))
        return result

    for module in (common, components, exact_dedup, near_dedup, pitman_yor, suffix_dedup, corpus_pipeline):
        monkeypatch.setattr(module, "written", cut_anew)
    try:
        spark.conf.set(SPLITS, "1g")
        assert read() == expected
    finally:
        spark.conf.set(SPLITS, before)
