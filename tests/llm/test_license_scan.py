from __future__ import annotations

import re
from collections import Counter

from barometry.llm import license_scan
from barometry.llm.license_scan import scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def expected(rows):
    result = []
    for doc_id, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        places, base, like, score = [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES.items():
            own = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += found
            base |= {label} if found else set()
        for label, text_ in license_scan.TEMPLATES:
            wanted = set(text_.split())
            for start in range(0, len(words), 32):
                shared = len(wanted & set(words[start : start + 64]))
                if shared * 100 >= 85 * len(wanted):
                    like.add(label)
                    score = max(score, shared / len(wanted))
        labels = ",".join(sorted(base | like))
        first, last = min(places, default=None), max(places, default=None)
        n = len(places)
        result.append((doc_id, len(words), n, first, last, ",".join(sorted(base)), labels, 1.0 if n else score))
    return result


def test_labels_and_places(spark, corpus):
    docs, rows = corpus
    texts = [
        "Under the MIT License. under--the mit license Under the mit license",
        "Apache License, Version 2.0 CC-BY-NC cc by nc",
        "mit under the license released",
        "the work: licensed, by K under the gnu K general public license version 3 this is",
        "under the mit licensé; under the mit",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    more = list(enumerate(texts, 2000))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert Counter(map(tuple, scan_licenses(both).collect())) == Counter(expected(rows + more))
