"""What workers remember between texts, and how the places of frequent blocks are dealt out."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from barometry.llm import exact_dedup, packing, token_count


def test_long_parts_are_not_remembered():
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    long = "abcdefgh" * 40
    for text in (f"a {long} b {long}", f"{long} {long}", f"some words {long}\n {long}", "a b"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert "b" in encoder._known
    assert max(map(len, encoder._known)) <= packing._LONG


def test_counts_of_long_parts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    long = "unbelievably" * 30
    rows = [f"{long} a {long}", f"a {long}", long, f"{long} {long}x a"]
    assert len(long) > token_count._LONG
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, path).collect()}
    assert found == {i: len(library.encode(text)) for i, text in enumerate(rows)}


@pytest.mark.parametrize("fields", [exact_dedup._PLACE, exact_dedup._ABOUT])
def test_places_of_one_block_are_dealt_out(spark, fields):
    """One key with places from many slices: no task makes all of its rows."""
    rows = []
    for i in range(64):
        places = np.zeros(50, fields)
        places["row"] = np.arange(i * 50, i * 50 + 50)
        rows.append((b"same", places.tobytes()))
    gathered = spark.createDataFrame(rows, "key binary, places binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        named = exact_dedup._give_names(gathered, fields).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.row for r in named) == list(range(64 * 50))
    assert len({r.name for r in named}) == 1
    sizes = np.unique([r.task for r in named], return_counts=True)[1]
    assert len(sizes) > 1 and sizes.max() < len(named) / 2
