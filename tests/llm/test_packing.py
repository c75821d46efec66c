from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barometry.llm.packing import CAPACITY, Encoder, fullest, minimum_slack, pack_documents

MAKE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library(corpus):
    rng = random.Random(2)
    parts = ["ab", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "ß漢", " ", "\x1c", "'s", " '", "1", "😀", "the"]
    texts = [text for _, text in corpus[1]] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(2000)]
    encoder = Encoder(*MAKE)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_one_call():
    encoder = Encoder(*MAKE)
    calls, plain = [], encoder._plain
    encoder._plain = lambda text: calls.append(text) or plain(text)
    for text in ("rare words of a text " * 40, "a<|endoftext|> b\n\n  c 漢字 " * 30, "z" * 65):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert calls.pop() == text and not calls
    assert not encoder._known


def test_pieces_fill_sequences_without_gaps(corpus):
    docs, rows = corpus
    found = pack_documents(docs, *MAKE).collect()
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        ends = [0, *np.cumsum([length for _, length in parts])]
        assert [offset for offset, _ in parts] == ends[:-1] and ends[-1] <= CAPACITY
    expected = []
    for i, text in rows:
        ids = [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        end = len(ids) % CAPACITY or min(CAPACITY, len(ids))
        while start < len(ids):
            own = np.array(ids[start:end], "<u4").tobytes()
            expected.append((i, piece, start, end - start, zlib.crc32(own)))
            start, end, piece = end, end + CAPACITY, piece + 1
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(expected, key=str)
    assert len(sequences) == -(-sum(r.length for r in found) // CAPACITY)


def test_fullest_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 80)
        lengths = sorted(counts, reverse=True)
        sums = {0}
        for length in lengths:
            sums |= {s + length * k for s in sums for k in range(counts[length] + 1)}
        chosen = fullest(room, lengths, counts)
        assert all(times <= counts[length] for length, times in chosen.items())
        assert sum(length * times for length, times in chosen.items()) == max(s for s in sums if s <= room)


def test_every_piece_has_a_place():
    histogram = {7: 3, 5: 10, 3: 2, 10: 1, 1: 4}
    plan = minimum_slack(histogram, 10)
    assert plan.sequences == -(-sum(k * n for k, n in histogram.items()) // 10)
