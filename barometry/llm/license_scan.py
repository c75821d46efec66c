"""License notices in texts: exact phrases, and an exact set-similarity join with templates.

A text block matches a template if it holds a given share of the template's words.
Words are ordered from the globally rarest on.  A block that matches must hold one of the
first words of the template in that order (the prefix), must have enough template words
at all (length), and enough of them from the shared word on (position).  Blocks that pass
are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Usual one-sentence notices of public licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
]

SHARE = Fraction(85, 100)
STEP = 32  # a block is twice as many words, so that every span of up to STEP words lies in one
# What stands between words; A-Z are in lower case by then.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# lower() turns this one letter into an ASCII letter, which it must not become.
_KELVIN = "\u212a"


def _spaced(text: Column) -> Column:
    """The words, each with a space on either side; empty without words."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("é")))
    words = F.trim(F.regexp_replace(lowered, _BETWEEN, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count_words(spaced: Column) -> Column:
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2)


def _phrase_columns(phrases: dict[str, str]) -> dict[str, Column]:
    spaced = F.col("spaced")
    found, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        words = phrase.split()
        form = F.lit("".join(f" {word} " for word in words))
        held = F.contains(spaced, form)
        size = len("".join(words)) + 2 * len(words)
        times = (F.length(spaced) - F.length(F.replace(spaced, form, F.lit("")))) / size
        found.append(F.when(held, F.round(times)).otherwise(0))
        firsts.append(F.when(held, _count_words(F.call_function("substring_index", spaced, form, F.lit(1)))))
        after = _count_words(F.call_function("substring_index", spaced, form, F.lit(-1)))
        lasts.append(F.when(held, F.col("n_words") - after - len(words)))
        labels.append(F.when(held, F.lit(label)))
    kept = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    return {
        "n_base": sum(found[1:], found[0]).cast("bigint"),
        "first_word": F.array_min(F.array(*firsts)).cast("bigint"),
        "last_word": F.array_max(F.array(*lasts)).cast("bigint"),
        "base": kept,
    }


def word_frequencies(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """How often each of the given words stands in all texts; only these counts reach the driver."""
    all_words = docs.select(F.explode(F.split(_spaced(F.col("text")), " ")).alias("word"))
    counted = all_words.filter(F.col("word").isin(*words)).groupBy("word").count().collect()
    return {word: 0 for word in words} | {row["word"]: row["count"] for row in counted}


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    share: Fraction = SHARE,
    step: int = STEP,
) -> DataFrame:
    """License labels of every text, from phrases and from blocks like a template.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.
    ``n_base`` counts the places where the words of a phrase stand one after the other,
    ``first_word`` and ``last_word`` are the first and last of them.  A block is
    ``2 * step`` words, and one begins every ``step`` words.  It has a template's label if it
    holds at least ``share`` of the template's distinct words.  ``score`` is 1 where a
    phrase stands, else the largest share found, and 0 without any.  A null text has no
    words; repeated rows each get a row.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({word for _, words in sets for word in words})
    frequency = word_frequencies(docs, vocabulary)
    order = {word: i for i, word in enumerate(sorted(vocabulary, key=lambda word: (frequency[word], word)))}
    index, firsts = [], set()
    for label, words in sets:
        ranks = sorted(order[word] for word in words)
        needed = math.ceil(share * len(ranks))
        for position, rank in enumerate(ranks[: len(ranks) - needed + 1]):
            index.append((rank, position, label, ranks, needed))
            firsts.add(rank)
    least = min(needed for *_, needed in index)
    spark = docs.sparkSession
    # One row per prefix word of a template: as many as the templates have words.
    prefixes = spark.createDataFrame(index, "rank int, position int, label string, ranks array<int>, needed int")

    spaced = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _spaced(F.col("text")).alias("spaced"),
    )
    counted = spaced.withColumn("n_words", _count_words(F.col("spaced")).cast("bigint"))
    words = F.split(F.trim("spaced"), "  ")
    by_rank = sorted(order, key=order.__getitem__)
    known = F.array(*map(F.lit, by_rank))
    rare = F.array(*(F.lit(by_rank[rank]) for rank in sorted(firsts)))

    def ranks_of(start: Column) -> Column:
        places = F.transform(F.slice(words, start, F.lit(2 * step)), lambda word: F.array_position(known, word))
        return F.array_sort(F.array_distinct(F.filter(places, lambda place: place > 0)))

    starts = F.sequence(F.lit(1), F.greatest(F.col("n_words").cast("int"), F.lit(1)), F.lit(step))
    blocks = F.filter(F.transform(starts, ranks_of), lambda block: F.size(block) >= least)
    scanned = counted.select(
        "row",
        "doc_id",
        "n_words",
        *[column.alias(name) for name, column in _phrase_columns(phrases).items()],
        F.when(F.arrays_overlap(words, rare), blocks).alias("blocks"),
    )
    scanned = written(scanned)

    block = scanned.filter(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block"))
    held = block.select("row", "block", F.posexplode("block").alias("place", "number"))
    pairs = held.join(F.broadcast(prefixes), F.col("number") - 1 == F.col("rank"))
    # From the shared word on, both sides must have enough words left.
    left = F.least(F.size("block") - F.col("place"), F.size("ranks") - F.col("position"))
    pairs = pairs.filter((F.size("block") >= F.col("needed")) & (left >= F.col("needed") - F.col("position")))
    shared = F.size(F.array_intersect("block", F.transform("ranks", lambda r: (r + 1).cast("bigint"))))
    matches = pairs.select("row", "label", "needed", shared.alias("shared"), F.size("ranks").alias("size"))
    matches = matches.filter("shared >= needed").withColumn("score", F.col("shared") / F.col("size"))
    per_row = matches.groupBy("row").agg(F.collect_set("label").alias("like"), F.max("score").alias("score"))

    joined = scanned.drop("blocks").join(per_row, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("like", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
