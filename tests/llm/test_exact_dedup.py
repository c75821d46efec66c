from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from barometry.llm.exact_dedup import exact_duplicates


@pytest.mark.parametrize("block", [4096, 64])
def test_groups_of_equal_texts(corpus, block):
    docs, rows = corpus
    plain = [re.sub("[\x20\x09-\x0d]", "", text) for _, text in rows]
    groups = defaultdict(list)
    for (i, text), key in zip(rows, plain, strict=True):
        groups[key].append((-len(text), i is None, i or 0))
    expected = Counter()
    for (i, text), key in zip(rows, plain, strict=True):
        _, unknown, keep = min(groups[key])
        sha = hashlib.sha256(key.encode()).hexdigest()
        expected[i, None if unknown else keep, len(groups[key]), sha, len(text)] += 1
    found = exact_duplicates(docs, block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_chars_text) for r in found) == expected
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
