"""Queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrywork.llm import ann, bpe, chat, licenses, mixing, quality, simhash, substring, token_counts, toxicity
from ferrywork.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, d), tokenizer("piece_bpe_32k.model"))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, d)).drop("spans")


def op5(spark: SparkSession, d: str) -> DataFrame:
    turns = documents(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(chat.PROBE))
    return chat.format_conversations(turns, tokenizer("byte_bpe_50k.tiktoken"), pattern())


def op9(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(documents(spark, d), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1,
        "op2_mixing": lambda spark, d: mixing.mix_documents(documents(spark, d)),
        "op3_license_scans": op3,
        "op4_simhash": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
        "op5_chat_formatting": op5,
        "op10_substring_dedup": lambda spark, d: substring.repeated_passages(documents(spark, d)),
        "op7_toxicity": lambda spark, d: toxicity.toxicity(documents(spark, d), documents(spark, d, "labels")),
        "op8_nearest_neighbours": lambda spark, d: ann.search(documents(spark, d, "embeddings")),
        "op9_byte_bpe": op9,
        "op6_quality_rules": lambda spark, d: quality.quality_rules(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.oracle()}
