"""The corpus pipeline: stages over documents, each stage's rows written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.llm import bpe, common, mixing, quality, queries, simhash, substring


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are. Null, empty and very short texts fail the rules and go; texts
    of any length are measured whole; repeated rows each get the same verdict; an empty table stays empty."""
    return quality.judge(docs, prefix="_q_").where("_q_kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id. Texts without words are near-duplicates of
    each other. Rows without doc_id stay, as do all rows of a doc_id that is kept; of a doc_id with several texts all rows
    go if one of them repeats a smaller doc_id. An empty table stays empty."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(copies, F.col("doc_id").cast("bigint") == F.col("_doc"), "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller doc_id has too; emptied documents go, n_chars follows.
    Null texts and rows without doc_id stay as they are; repeated rows are cut alike; an empty table stays empty."""
    return substring.remove_passages(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, up to twice. A null source is a source; rows without words or
    doc_id stay once; rows that repeat a doc_id come equally often; an empty table stays empty."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each row; a null text is empty; an empty table stays empty."""
    return bpe.round_trip(docs, queries.tokenizer("byte_bpe_multi_50k.tiktoken"), queries.pattern())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: Near-duplicate groups and the mix cannot be put in SQL; tests hold run() against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. What a stage writes lies in the checkpoint folder, which all share, until
    the next one is written."""
    docs, before = common.documents(spark, sf_dir), ""
    root = f"{common.checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{root}/{k}-{name}"
        out.write.parquet(path)
        common.release(spark)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
