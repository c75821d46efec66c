"""Quality of texts by regularised quadratic discriminant analysis.

Each text becomes a few transformed statistics.  Two Gaussians, one per label, are
fitted to them from class sums that Spark adds up over all labelled rows; their
covariances are shrunk towards the pooled one and its diagonal.  A score is the
difference of the two log densities, from Mahalanobis distances by cached Cholesky
factors, brought between 0 and 1.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, remainder, texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLICE = 2**21
_FOLD, _HELD_OUT = 3, 1
_POOLED, _DIAGONAL = 0.1, 0.1  # shares of the pooled covariance and of its diagonal
STATISTICS = [
    "log_words", "log_word_length", "upper", "symbols", "stops", "marked_words", "bars",
    "distinct_words", "distinct_pairs", "repeats", "line_words", "digits",
]

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = slice(65, 91)
_DIGIT = slice(48, 58)
_STOPS = [ord(c) for c in ".,;:!?"]
_PLAIN = np.zeros(256, bool)  # what prose is made of besides letters and digits
_PLAIN[[9, 10, 11, 12, 13, 32, *map(ord, ".,;:!?'\"()-")]] = True


def _share(part: float, whole: float) -> float:
    """A share from 0 to 1, spread out at its low end."""
    return float(np.sqrt(part / whole)) if whole else 0.0


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; all zero for an empty one."""
    data = text.encode()
    counts = np.zeros(256, np.int64)
    for start in range(0, len(data), _SLICE):
        counts += np.bincount(np.frombuffer(data[start : start + _SLICE], np.uint8), minlength=256)
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    letters = int(counts[_LETTERS].sum())
    digits = int(counts[_DIGIT].sum())
    symbols = size - letters - digits - int(counts[_PLAIN].sum())
    marked = sum(not word[-1:].isalnum() and word[-1] < 128 for word in words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)),
        float(np.log(size / n)),
        _share(int(counts[_UPPER].sum()), letters),
        _share(symbols, size),
        _share(int(counts[_STOPS].sum()), size),
        _share(marked, n),
        _share(int(counts[ord("|")]), n),
        # How far distinct words fall behind what a text of that length has.
        float(np.log(len(set(words))) / np.log(n + 1)),
        _share(max(n - 1 - pairs, 0), max(n - 1, 1)),
        _share(sum(map(eq, words, words[1:])), max(n - 1, 1)),
        float(np.log(n / (int(counts[10]) + 1))),
        _share(digits, size),
    ]


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded_batches(batches, _SLICE):
        rows = np.array([statistics(text) for text in batch.column(1).to_pylist()])
        columns = [batch.column(0), *(pa.array(x) for x in rows.T)]
        yield pa.record_batch(columns, ["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text; a null text counts as empty."""
    fields = ", ".join(f"{name} double" for name in STATISTICS)
    return texts(docs).mapInArrow(_measured, f"doc_id bigint, {fields}")


class Discriminant:
    """Two Gaussians and the log odds between them."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """``sums``: per label the number of rows, the sum and the sum of outer products."""
        d = len(STATISTICS)
        counts = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
        self.prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
        self.fitted = min(counts) >= 2
        if not self.fitted:
            return
        self.means = [sums[k][1] / sums[k][0] for k in (0, 1)]
        scatter = [sums[k][2] - sums[k][0] * np.outer(m, m) for k, m in zip((0, 1), self.means, strict=True)]
        pooled = (scatter[0] + scatter[1]) / sum(counts)
        floor = 1e-6 * np.eye(d)
        self.factors, self.constants = [], []
        for s, n in zip(scatter, counts, strict=True):
            shared = _POOLED * pooled + _DIAGONAL * np.diag(np.diag(pooled))
            factor = np.linalg.cholesky((1 - _POOLED - _DIAGONAL) * s / n + shared + floor)
            self.factors.append(np.linalg.inv(factor))
            self.constants.append(-float(np.log(np.diag(factor)).sum()))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, with the prior, for each row of statistics."""
        odds = np.full(len(x), self.prior)
        if self.fitted:
            for sign, mean, inverse, constant in zip((-1, 1), self.means, self.factors, self.constants, strict=True):
                z = (x - mean) @ inverse.T
                odds += sign * (constant - 0.5 * (z * z).sum(axis=1))
        return odds

    def score(self, x: np.ndarray) -> np.ndarray:
        """The odds brought between 0 and 1, a half where both labels are as likely.

        The statistics are no Gaussians, and the odds of clear cases run into the thousands:
        as probabilities they would all be 0 or 1.  An algebraic curve keeps them apart;
        its unit is the number of statistics, which is what a squared distance is on average.
        """
        z = self.log_odds(x) / len(STATISTICS)
        # The smaller of both sides is computed without a difference of near equals.
        low = 0.5 / (1 + z * z + np.abs(z) * np.sqrt(1 + z * z))
        return np.where(z < 0, low, 1 - low)


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits to all labelled rows outside the held-out fold.

    Only class sums reach the driver: one row per label, as long as there are pairs of
    statistics.  A label other than 0 and 1, or of a null id, teaches nothing.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & (remainder(_FOLD) != _HELD_OUT)).distinct()
    rows = measured.join(marks, "doc_id")
    products = [(a, b) for i, a in enumerate(STATISTICS) for b in STATISTICS[i:]]
    sums = [F.sum(a) for a in STATISTICS] + [F.sum(F.col(a) * F.col(b)) for a, b in products]
    found = rows.groupBy("label").agg(F.count(F.lit(1)), *sums).collect()
    d = len(STATISTICS)
    result = {}
    for label, n, *values in found:
        outer = np.zeros((d, d))
        outer[np.triu_indices(d)] = values[d:]
        result[label] = (float(n), np.array(values[:d]), outer + np.triu(outer, 1).T)
    return Discriminant(result)


def _scored(model: Discriminant):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(name).to_numpy() for name in STATISTICS], axis=1)
            score = pa.array(model.score(x) if len(x) else np.zeros(0))
            yield pa.record_batch([batch.column(0), score], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A score from 0 to 1 that a text is of quality 1, learned from ``labels``.

    Rows whose id is in the held-out fold (crc32 of the id modulo 3 is 1) are never
    learned from.  Every row is scored, empty and null texts too, repeated rows alike.
    Where a label has fewer than two rows to learn from, all scores are its prior.
    Returns ``doc_id, held_out, score, predicted``.
    """
    measured = written(measure(docs))
    scores = measured.mapInArrow(_scored(fit(measured, labels)), "doc_id bigint, score double")
    held_out = F.coalesce(remainder(_FOLD) == _HELD_OUT, F.lit(False))
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _good(model: Discriminant, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, _SLICE):
            x = np.array([statistics(text or "") for text in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose score by :func:`score_quality` reaches ``threshold``.

    Texts are measured once to learn and once to decide, so that none is shuffled.
    """
    model = fit(written(measure(docs)), labels)
    return docs.mapInArrow(_good(model, threshold), docs.schema)
