from __future__ import annotations

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Some rows of the test documents and awkward ones: nulls, repeats, ties, long and empty texts."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (None, None, None, None, None),
        (None, "Over the lazy dog " * 9, None, None, None),
        (1000, "", "en", "a", 0),
        (1001, " \t\n\x0b\x0c\r", "en", "a", 6),
        (1002, "one", "en", "a", 3),
        (1003, "ONE", "en", "a", 3),
        (1004, long, "en", "b", len(long)),
        (1005, long + " end", "en", "b", len(long) + 4),
        (1006, "Ünder the MIT License. K " * 4, "en", "b", 1),
        (1006, "Ünder the MIT License. K " * 4, "en", "b", 1),
        (1007, "x" * 9000, "en", "b", 9000),
        (1007, "x" * 9001, "en", "b", 9001),
        (1008, "a\x00b ▁ <s> <|endoftext|> 字 😀", "en", "c", 9),
        (-5, "x " * 4500 + "x" * 4500, "en", "c", 1),
    ]
    made = given.unionByName(spark.createDataFrame(rows, FIELDS)).coalesce(3)
    rows = [(row.doc_id, row.text or "") for row in made.collect()]
    return made, rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def clashing(spark):
    """A table with further columns that operators use as names of their own."""
    names = ["row", "cell", "part", "node", "n", "kind", "key", "slot", "block", "score", "shard", "Text2", "count", "name"]
    extra = ", ".join(f"{name} string" for name in names)
    rows = [(i, f"some words of text number {i} " * 5, *["x"] * len(names)) for i in range(4)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")
