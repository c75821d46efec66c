from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barometry.llm.quality import STATISTICS, Discriminant, keep_good, score_quality, statistics

FOLDER = "/root/testdata/sf0.01"


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    own = [r for r in scored if r.held_out]
    assert np.mean([r.predicted == r.quality for r in own]) > 0.97


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(4)
    d = len(STATISTICS)
    x = {k: rng.normal(k, 1 + k, (400, d)) for k in (0, 1)}
    model = Discriminant({k: (400.0, v.sum(axis=0), v.T @ v) for k, v in x.items()})
    point = rng.normal(0.5, 1, (5, d))
    covariance = [np.cov(v.T, bias=True) for v in x.values()]
    pooled = (covariance[0] + covariance[1]) / 2
    logs = []
    for k in (0, 1):
        s = 0.8 * covariance[k] + 0.1 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        z = point - x[k].mean(axis=0)
        logs.append(-0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    odds = logs[1] - logs[0]
    assert model.log_odds(point) == pytest.approx(odds)
    assert model.score(point) == pytest.approx(0.5 + odds / d / (2 * np.sqrt(1 + (odds / d) ** 2)))


def plain_statistics(text):
    """Letter by letter, word by word."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if w]
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    letter = [c >= 128 or chr(c).isalpha() for c in data]
    prose = [is_letter or chr(c) in "0123456789\t\n\x0b\x0c\r .,;:!?'\"()-" for c, is_letter in zip(data, letter, strict=True)]
    share = lambda part, whole: math.sqrt(part / whole) if whole else 0.0
    marked = sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in words)
    pairs = list(itertools.pairwise(words))
    return [
        math.log(1 + n), math.log(size / n), share(sum(65 <= c <= 90 for c in data), sum(letter)), share(prose.count(False), size),
        share(sum(chr(c) in ".,;:!?" for c in data), size), share(marked, n), share(data.count(b"|"), n),
        math.log(len(set(words))) / math.log(n + 1), share(len(pairs) - len(set(pairs)), max(n - 1, 1)),
        share(sum(a == b for a, b in pairs), max(n - 1, 1)), math.log(n / (data.count(b"\n") + 1)), share(sum(48 <= c <= 57 for c in data), size),
    ]


def test_statistics_and_scores_against_plain_python(spark, corpus):
    docs, rows = corpus
    for _, text in rows:
        assert statistics(text) == pytest.approx(plain_statistics(text), abs=1e-12)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    x = {k: np.array([plain_statistics(texts[i]) for i, q in known.items() if q == k and i in texts]) for k in (0, 1)}
    covariance = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    n = {k: len(v) for k, v in x.items()}
    pooled = (n[0] * covariance[0] + n[1] * covariance[1]) / (n[0] + n[1])
    found = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    for i in list(texts)[:300]:
        odds = math.log((n[1] + 1) / (n[0] + 1))
        for k, sign in ((0, -1), (1, 1)):
            s = 0.8 * covariance[k] + 0.1 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(STATISTICS))
            z = np.array(plain_statistics(texts[i])) - x[k].mean(axis=0)
            odds += sign * -0.5 * (np.linalg.slogdet(s)[1] + z @ np.linalg.solve(s, z))
        assert found[i] == pytest.approx(0.5 + odds / 12 / (2 * math.sqrt(1 + (odds / 12) ** 2)), abs=1e-9)


def test_scores_tell_documents_apart(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    scores = [r.score for r in score_quality(docs, labels).collect()]
    assert len(set(scores)) > 0.8 * len(scores) and 0 < min(scores) and max(scores) < 1


def test_awkward_rows_are_scored_and_kept_whole(spark, corpus):
    docs, rows = corpus
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    more = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0)], labels.schema)
    scored = score_quality(docs, labels.unionByName(more)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())


def test_without_labels_all_scores_are_alike(spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(corpus[0], labels).collect()} == {0.5}


def test_empty_texts_have_statistics():
    assert statistics("") == statistics(" \n") == [0.0] * len(STATISTICS)
