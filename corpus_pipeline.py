"""A training corpus in five stages: quality, near duplicates, repeated passages, mixing, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
All but the first begin by giving back the executors' memory that the stage before has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyadjust.llm import bpe, jaccard, mixing, phrases, quality
from skyadjust.llm._common import DOC_COLUMNS, Scratch, shrink_executors
from skyadjust.llm.queries import table, tokenizer_json


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score is at least the threshold."""
    docs = docs.select(*DOC_COLUMNS)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of the n-gram Jaccard join."""
    shrink_executors(spark)
    return jaccard.keep_first(docs.select(*DOC_COLUMNS))


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of recurring passages; n_chars follows.  No row goes."""
    shrink_executors(spark)
    return phrases.strip(docs.select(*DOC_COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0, 1 or 2 times) as the mix of sources takes them."""
    shrink_executors(spark)
    return mixing.apply(docs.select(*DOC_COLUMNS))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed), their number, and digests of ids and decoded text."""
    shrink_executors(spark)
    return bpe.encode(docs, tokenizer_json(), packed=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", repeated_passage_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", token_stage),
]

#: SQL cannot express the classifier's fit or the tokenizer; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{i + 1}")
    return docs
