from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barometry.llm import pitman_yor
from barometry.llm.common import lower_bytes, word_hashes, words_of
from barometry.llm.pitman_yor import (
    _AT_ONCE,
    _END,
    DISCOUNTS,
    STRENGTH,
    Part,
    Seating,
    _differences,
    _from_differences,
    _numbered_pairs,
    cell_pairs,
    score_texts,
)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def test_counts_and_unigram(corpus):
    docs, rows = corpus
    counts = Counter()
    for i, text in rows:
        if not held_out(i):
            counts.update([*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    found = sorted(score_texts(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    expected = []
    for i, text in rows:
        words = [*words_of(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        expected.append((i, held_out(i), len(words), sum(counts[w] > 0 for w in words), n, base))
    expected.sort(key=lambda e: (str(e[0]), e[2], e[5]))
    for r, e in zip(found, expected, strict=True):
        assert tuple(r)[:5] == e[:5] and r.base_score == pytest.approx(e[5], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_held_out_texts_are_more_probable_than_to_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in score_texts(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    model, base = (10 ** (-sum(r[name] for r in rows) / tokens) for name in ("score", "base_score"))
    assert model < 0.5 * base


def test_pairs_of_texts():
    texts = [b"A b a b", b"", b"b\ta"]
    words, own, context, word, pair, lengths = cell_pairs(texts)
    names = {int(w): n for w, n in zip(words, np.array(["a", "b", "end"])[np.argsort(np.argsort(words))], strict=True)}
    assert lengths.tolist() == [5, 1, 3] and len(names) == 3
    tokens = words[word]
    before = np.r_[_END, tokens[:-1]]
    assert (words[own[pair]] == tokens).all() and (words[context[pair]] == before).all()
    assert len(own) == len({*zip(tokens.tolist(), before.tolist(), strict=True)})


def test_short_texts_are_hashed_together(monkeypatch):
    """Calls grow with the bytes and not with the texts, and the pairs are those of text after text."""
    rng, calls = random.Random(8), []
    texts = [b" ".join(rng.choices([b"A", b"b", b"cD", b"\t", "\u00e9".encode()], k=i % 7)) for i in range(3000)]
    texts[50] = b" x" * _AT_ONCE

    def counted(data, *args, **kinds):
        calls.append(len(data))
        return word_hashes(data, *args, **kinds)

    monkeypatch.setattr(pitman_yor, "word_hashes", counted)
    words, own, context, word, pair, lengths = cell_pairs(texts)
    assert len(calls) <= 2 + sum(len(text) + 1 for text in texts) // _AT_ONCE
    every = [np.append(word_hashes(lower_bytes(text)), _END) for text in texts]
    tokens = np.concatenate(every)
    known, number = np.unique(tokens, return_inverse=True)
    before = np.append(np.searchsorted(known, _END), number[:-1])
    pairs, which = np.unique(number << 32 | before, return_inverse=True)
    expected = known, pairs >> 32, pairs & 0xFFFFFFFF, number, which, [len(x) for x in every]
    for x, y in zip((words, own, context, word, pair, lengths), expected, strict=True):
        assert np.array_equal(x, y)


@pytest.mark.parametrize("large", [1, 2**28])
def test_pairs_are_numbered_in_order(large):
    rng = np.random.default_rng(9)
    x, y = (rng.integers(0, 30, 500) * large for _ in range(2))
    pairs, number = _numbered_pairs(x, y)
    expected = np.unique(x << 32 | y, return_inverse=True)
    assert np.array_equal(pairs, expected[0]) and np.array_equal(number, expected[1])


def test_one_dish_follows_the_restaurant():
    """Tables after many steps against all seatings with their weights."""
    rng, opening, discount, dishes, n = np.random.default_rng(2), 0.7, 0.5, 4000, 7
    rows = np.arange(dishes)
    # A table of k customers weighs (1 - d)(2 - d)..(k - 1 - d), times ``opening``.
    weights = defaultdict(float)

    def seat(sizes, weight, left):
        if not left:
            weights[len(sizes)] += weight
            return
        merged = Counter(sizes)
        for size, times in merged.items():
            grown = list(sizes)
            grown[grown.index(size)] += 1
            seat(tuple(sorted(grown)), weight * times * (size - discount), left - 1)
        seat(tuple(sorted([*sizes, 1])), weight * opening, left - 1)

    seat((1,), opening, n - 1)
    seating = Seating.start(np.full(dishes, n))
    for _ in range(100):
        seating.remove(rows, rng)
        seating.add(rows, np.full(dishes, opening), discount, rng)
    assert (seating.customers() == n).all() and (np.diff(seating.dish) >= 0).all() and seating.sizes.min() > 0
    expected = sum(t * w for t, w in weights.items()) / sum(weights.values())
    assert seating.tables().mean() == pytest.approx(expected, rel=0.03)


def mean_tables(n, opening, discount):
    """Of one dish with ``n`` customers, over all seatings with their weights."""
    weights = {1: 0.0}  # logarithms, by the number of tables
    for seated in range(1, n):
        grown = defaultdict(lambda: -math.inf)
        for t, w in weights.items():
            grown[t] = np.logaddexp(grown[t], w + math.log(seated - discount * t))
            grown[t + 1] = np.logaddexp(grown[t + 1], w + math.log(opening))
        weights = grown
    chances = {t: math.exp(w - max(weights.values())) for t, w in weights.items()}
    return sum(t * x for t, x in chances.items()) / sum(chances.values())


@pytest.mark.parametrize(("n", "opening"), [(2, 0.3), (40, 4.0), (300, 20.0)])
def test_sweeps_of_a_dish_of_any_size_follow_the_restaurant(n, opening):
    rng, discount, dishes = np.random.default_rng(3), 0.8, 300
    seating, expected, found = Seating.start(np.full(dishes, n)), mean_tables(n, opening, discount), []
    for _ in range(60):
        seating.redraw(discount, lambda rows, _: np.full(len(rows), opening), lambda *_: None, lambda: None, rng)
        found.append(seating.tables().mean())
    assert (seating.customers() == n).all() and (np.diff(seating.dish) >= 0).all() and seating.sizes.min() > 0
    assert np.mean(found[40:]) == pytest.approx(expected, rel=0.04)


def test_a_sweep_draws_every_customer_once(monkeypatch):
    left, leave = Counter(), Seating.leave

    def counted(self, take, rng, waiting=None):
        gone = leave(self, take, rng, waiting)
        left.update(map(int, self.names[gone[0]]))
        return gone

    def taken(self, rows, take=Seating.taken):
        part = take(self, rows)
        part.names = self.names[rows]
        return part

    monkeypatch.setattr(Seating, "leave", counted)
    monkeypatch.setattr(Seating, "taken", taken)
    customers = np.array([1, 2, 64, 0, 65, 3, 5000, 1, 129])
    seating, rng, tables = Seating.start(customers), np.random.default_rng(5), np.zeros(9, np.int64)
    seating.names = np.arange(9)
    before = seating.tables()

    def moved(rows, change):
        tables[rows] += change

    seating.redraw(0.8, lambda rows, _: np.full(len(rows), 3.0), moved, lambda: None, rng)
    assert [left[i] for i in range(9)] == np.where(customers > 1, customers, 0).tolist()
    assert (seating.customers() == customers).all() and (seating.tables() == before + tables).all()


def test_sweeps_keep_parent_and_totals_up_to_date():
    rng = np.random.default_rng(6)
    word, context, counts = np.repeat(np.arange(30), 20), np.tile(np.arange(20), 30), rng.zipf(1.3, 600).clip(1, 4000)
    part = Part.start(30, word, context, counts)
    dishes = np.bincount(part.home)
    root, tables = [float(part.top.sizes.sum()), float(len(part.top.sizes)), 31], dishes + part.extra(part.low.tables())
    for i in range(4):
        part.sweep(tables, root, rng, i == 0)
        assert root[:2] == [part.top.sizes.sum(), len(part.top.sizes)]
        assert (part.low.customers() == counts[counts > 1]).all()
        assert part.top.customers().tolist() == (part.single + np.bincount(part.word, part.low.tables(), 30)).tolist()
        assert (tables == dishes + part.extra(part.low.tables())).all()


def test_state_survives_packing():
    part = Part.start(3, np.array([0, 0, 1, 2]), np.array([5, 9, 5, 7]), np.array([4, 1, 9, 2**33]))
    root = [float(part.top.sizes.sum()), float(len(part.top.sizes)), 4]
    for i in range(5):
        part.step(np.array([3, 2]), root, np.random.default_rng(i), i == 0)
    assert root[:2] == [part.top.sizes.sum(), len(part.top.sizes)]
    assert part.low.customers().tolist() == [4, 9, 2**33]
    assert part.top.customers().tolist() == (part.single + np.bincount(part.word, part.low.tables(), 3)).tolist()
    part.kept.append((part.low.tables(), part.top.customers(), part.top.tables()))
    again = Part.unpacked(part.packed())
    assert again.packed() == part.packed() and (again.home == part.home).all()


class Plain:
    """The same model in plain Python: every customer of every restaurant redrawn in turn, nothing frozen."""

    def __init__(self, texts, seed):
        self.rng = random.Random(seed)
        self.seats = defaultdict(lambda: defaultdict(list))  # restaurant (None: the parent), dish, table sizes
        self.data = [(u, w) for words in texts for u, w in zip(["/", *words], [*words, "/"], strict=True)]
        self.vocabulary = len({w for _, w in self.data})
        for u, w in self.data:
            self.add(u, w)

    def totals(self, u):
        dishes = self.seats[u].values()
        return sum(map(sum, dishes)), sum(map(len, dishes))

    def parent(self, u, w):
        return self.probability(None, w) if u is not None else 1 / (self.vocabulary + 1)

    def probability(self, u, w):
        d, (customers, tables) = DISCOUNTS[u is not None], self.totals(u)
        own = self.seats[u].get(w, [])
        return (sum(own) - d * len(own) + (STRENGTH + d * tables) * self.parent(u, w)) / (STRENGTH + customers)

    def add(self, u, w):
        d, own = DISCOUNTS[u is not None], self.seats[u][w]
        new = (STRENGTH + d * self.totals(u)[1]) * self.parent(u, w)
        at = self.rng.choices(range(len(own) + 1), [*(size - d for size in own), new])[0]
        if at < len(own):
            own[at] += 1
            return
        own.append(1)
        if u is not None:
            self.add(None, w)

    def remove(self, u, w):
        own = self.seats[u][w]
        at = self.rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        if not own[at]:
            del own[at]
            if u is not None:
                self.remove(None, w)
        if not own:
            del self.seats[u][w]

    def sweep(self):
        for u, w in self.data:
            self.remove(u, w)
            self.add(u, w)


TINY = [" ".join(random.Random(i).choices("abcdefg", [9, 6, 4, 3, 2, 1, 1], k=i % 10)) for i in range(40)]
TINY += ["new york is new", "new york", "a b a b zebra"] * 2


def pairs_of(text):
    words = text.split()
    return list(zip(["/", *words], [*words, "/"], strict=True))


@pytest.fixture(scope="module")
def plain():
    """log10 probabilities of the pairs of all texts, averaged over many sweeps."""
    learned = [text.split() for i, text in enumerate(TINY) if not held_out(i)]
    model, sums, samples = Plain(learned, 7), defaultdict(float), 300
    pairs = {pair for text in TINY for pair in pairs_of(text)}
    for i in range(samples + 20):
        model.sweep()
        if i >= 20:
            for u, w in pairs:
                sums[u, w] += model.probability(u, w) / samples
    return {pair: math.log10(value) for pair, value in sums.items()}


def test_long_chains_agree_with_a_plain_sampler(plain):
    learned = Counter(pair for i, text in enumerate(TINY) if not held_out(i) for pair in pairs_of(text))
    names = sorted({w for _, w in learned})
    number = {w: i for i, w in enumerate(names)}
    word, context, counts = np.array(sorted((number[w], number[u], n) for (u, w), n in learned.items())).T
    v = len(names)
    dishes, customers = (np.bincount(context, x, v) for x in (None, counts))
    part, rng = Part.start(v, word, context, counts), np.random.default_rng(1)
    root, sums, samples = [float(part.top.sizes.sum()), float(len(part.top.sizes)), v + 1], 0, 800
    d0, d1 = DISCOUNTS
    for i in range(samples + 20):
        total = (dishes[part.restaurants] + part.extra(part.low.tables())).astype(np.int64)
        for j in range(5):
            part.step(total, root, rng, i + j == 0)
        if i < 20:
            continue
        tables = np.ones(len(counts))
        tables[counts > 1] = part.low.tables()
        own = np.zeros((v, v))
        own[context, word] = counts - d1 * tables
        parent = part.top.customers() - d0 * part.top.tables() + (STRENGTH + d0 * root[1]) / (v + 1)
        new = (STRENGTH + d1 * np.bincount(context, tables, v))[:, None] * parent / (STRENGTH + root[0])
        sums = sums + (own + new) / (STRENGTH + customers)[:, None] / samples
    for text in TINY:
        pairs = pairs_of(text)
        if all(w in number for _, w in pairs):
            score = sum(math.log10(sums[number[u], number[w]]) for u, w in pairs)
            assert score == pytest.approx(sum(plain[pair] for pair in pairs), rel=0.02, abs=0.08)


def test_scores_agree_with_a_plain_sampler(spark, plain):
    docs = spark.createDataFrame(list(enumerate(TINY)), "doc_id long, text string").repartition(3)
    for r in score_texts(docs, parts=4, kept=5).collect():
        assert r.score == pytest.approx(sum(plain[pair] for pair in pairs_of(TINY[r.doc_id])), rel=0.1, abs=0.2)


def test_differences_come_back():
    rng = np.random.default_rng(4)
    of_word = [rng.integers(0, 90, 50) for _ in range(1 + 3 + 6)]
    tables, customers, opened = _from_differences(_differences(of_word, 3), 3)
    for found, expected in ((tables, of_word[1:4]), (customers, of_word[4::2]), (opened, of_word[5::2])):
        assert all((x == y).all() for x, y in zip(found, expected, strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_dishes_taken_and_put_back(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, 40)
    seating, whole = (Seating.start(counts) for _ in range(2))
    rows = np.flatnonzero(rng.random(40) < 0.4)
    part = seating.taken(rows)
    assert (part.customers() == counts[rows]).all()
    seating.put(rows, part)
    assert (seating.sizes == whole.sizes).all() and (seating.tables() == whole.tables()).all()
    # Dishes that change much go on alone; the others stay as they are.
    change = np.where(np.arange(40) % 13 == 0, 30, np.where(counts > 3, -rng.integers(0, 4, 40), 0))
    Part._follow(seating, change, 0.5, rng)
    assert (seating.customers() == counts + change).all()
    same = change == 0
    assert (seating.tables()[same] == whole.tables()[same]).all()
    assert (seating.sizes[np.isin(seating.dish, np.flatnonzero(same))] == whole.sizes[np.isin(whole.dish, np.flatnonzero(same))]).all()
