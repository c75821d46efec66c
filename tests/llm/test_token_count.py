from __future__ import annotations

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barometry.llm.token_count import PieceMerger, count_tokens, read_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MERGER = PieceMerger(read_pieces(PATH))


def test_counts_are_those_of_the_library(corpus):
    docs, rows = corpus
    found = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    lengths = [len(ids) for ids in LIBRARY.encode([text for _, text in rows], num_threads=1)]
    expected = [(i, len(t.encode()), n, n > 4096) for (i, t), n in zip(rows, lengths, strict=True)]
    assert found == sorted(expected, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aabtheinr▁字é", min_size=1, max_size=60), min_size=1, max_size=5))
def test_parts_merge_like_the_library(parts):
    plain = [f"▁{part.replace('▁', '')}" for part in parts]
    assert MERGER.counts(plain).tolist() == [len(LIBRARY.encode(part[1:])) or 1 for part in plain]
