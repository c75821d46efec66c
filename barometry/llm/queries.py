"""Registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import oracle
from .common import documents
from .conversation_repair import damage, repair_report
from .decontamination import find_contamination
from .exact_dedup import exact_duplicates
from .license_scan import scan_licenses
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pitman_yor import score_texts
from .prefix_trie import conversation_paths, prefix_trie, share_openings
from .quality import score_quality
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .token_count import count_tokens
from .url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).drop("removed")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(documents(spark, folder))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), size=2).drop("row", "first")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(documents(spark, folder))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder)).drop("row", "n_chars_text")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    # The rank file holds the same vocabulary as byte_bpe_50k.json, whose one special token is given.
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack_documents(documents(spark, folder), ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(documents(spark, folder))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_report(damage(spark.read.parquet(f"{folder}/conversations.parquet")))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{folder}/pages.parquet"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    return prefix_trie(share_openings(conversation_paths(turns)))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_decontamination": op4_decontamination,
        "op5_near_dedup": op5_near_dedup,
        "op6_sharding": op6_sharding,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_language_model": op9_language_model,
        "op10_quality": op10_quality,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_url_filter": op12_url_filter,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": oracle.license_scan(),
        "op6_sharding": oracle.sharding(),
        "op7_exact_dedup": oracle.exact_dedup(),
        "op11_conversation_repair": oracle.conversation_repair(),
        "op13_prefix_trie": oracle.prefix_trie(),
    }
