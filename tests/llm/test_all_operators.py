"""Every operator on empty tables and on tables with further columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barometry.llm import (
    decontamination,
    exact_dedup,
    license_scan,
    near_dedup,
    packing,
    pitman_yor,
    quality,
    sharding,
    suffix_dedup,
    token_count,
)


def _labels(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


def _items(docs):
    return docs.select(F.col("doc_id").alias("item_id"), "text")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "tokens": lambda d: token_count.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    "repeats": suffix_dedup.remove_repeats,
    "licenses": license_scan.scan_licenses,
    "contamination": lambda d: decontamination.find_contamination(d, _items(d)),
    "near": near_dedup.near_duplicates,
    "shards": sharding.shard_documents,
    "exact": exact_dedup.exact_duplicates,
    "packing": lambda d: packing.pack_documents(d, RANKS, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}),
    "scores": pitman_yor.score_texts,
    "quality": lambda d: quality.score_quality(d, _labels(d)),
    "good": lambda d: quality.keep_good(d, _labels(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_further_columns_do_no_harm(clashing, name):
    result = OPERATORS[name](clashing)
    assert {row["doc_id"] for row in result.collect()} == {0, 1, 2, 3}
    assert len(set(result.columns)) == len(result.columns)
