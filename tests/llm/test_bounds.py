"""Cells and parts follow the bytes of the texts."""

from __future__ import annotations

import pytest

from barometry.llm import pitman_yor, suffix_dedup
from barometry.llm.common import cell_rows, packed_cells, parts_for


def test_a_cell_ends_at_a_byte_bound_and_parts_grow(spark):
    rows = spark.createDataFrame([(i, False, "a" * 1000) for i in range(20)], "doc_id long, flag boolean, text string").coalesce(1)
    cells = [cell_rows(bytes(r.data)) for r in packed_cells(rows, 100, 3000).collect()]
    assert [len(texts) for *_, texts in cells] == [3] * 6 + [2]
    assert sorted(i for ids, *_ in cells for i in ids.tolist()) == list(range(20))
    assert [parts_for(rows, 2**27, 4), parts_for(rows, 1000, 4)] == [4, 32]


@pytest.mark.parametrize("module, run", [(suffix_dedup, "remove_repeats"), (pitman_yor, "score_texts")])
def test_registered_operators_take_more_parts_for_more_text(spark, monkeypatch, module, run):
    rows = [(i, f"text {i} " + "one passage that is in every text of this table and longer than a string " * 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    used = []
    monkeypatch.setattr(module, "parts_for", lambda *a: used.append(parts_for(*a)) or used[-1])
    result = []
    for size in (2**27, 8):
        monkeypatch.setattr(module, "_PART", size)
        result.append(sorted((r.doc_id, r.n_bytes, r.n_removed) if run == "remove_repeats" else (r.doc_id, r.n_tokens, r.n_known) for r in getattr(module, run)(docs).collect()))
    assert used == [256, 512] and result[0] == result[1]
