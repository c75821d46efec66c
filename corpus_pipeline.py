"""From raw documents to packed sequences, in five stages.

Each stage takes the documents that the one before has kept and returns those that it
keeps, whole rows as they are; the last one packs them.  Null texts count as empty; empty
and repeated ones are one group of equal texts, of which one stays.  Null ids are as good
as others: rows are told apart by a number.  Empty tables give none, and further columns
go through, whatever they are called, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry.llm.common import free_name, temporary, written, written_to
from barometry.llm.decontamination import keep_clean
from barometry.llm.exact_dedup import exact_duplicates
from barometry.llm.near_dedup import near_duplicates
from barometry.llm.packing import pack_documents
from barometry.llm.quality import keep_good

#: Texts are tokenised, aligned and measured in Python; no SQL says the same.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with numbers that stay, and the name of their column.

    Written, since each scan would number them anew.
    """
    row = free_name(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id())), row


def _without(numbered: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The documents but those whose number is in ``dropped (row)``, which may be a share of all."""
    rows = dropped.select(F.col("row").alias(row)).distinct()
    return numbered.join(rows.hint("merge"), row, "left_anti").drop(row)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal up to white space."""
    numbered, row = _numbered(docs)
    return _without(numbered, row, exact_duplicates(numbered, row=row).filter("not kept")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their five-word shingles.

    Documents of fewer than five words are linked by their whole sequence of words; empty
    ones are linked with nothing and stay.
    """
    numbered, row = _numbered(docs)
    return _without(numbered, row, near_duplicates(numbered, row=row).filter("not first")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a copy of a benchmark item, edited or not."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece of a document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack_documents(docs, ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    What a stage writes for itself, and the result of the stage before, are removed when
    its own result is there.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with temporary(spark) as own:
            if path is not None:
                own.append(path)
            path = written_to(stage(spark, docs, sf_dir))
            docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
