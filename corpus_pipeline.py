"""Corpus preparation: from raw documents to packed training sequences.

Each stage gets what the stage before it kept, as a Parquet table, and returns a
DataFrame; all but the last return the columns of ``documents``, and whatever other
columns there are.  Every row is judged by its own text: null and empty texts, null or
repeated ids, repeated rows, ties and texts of any length go through every stage, as its
operator's docstring says, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxlake.llm import decontaminate, jaccard_join, packing, pii, quality
from voxlake.llm.common import delete_path, scratch, shared_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels, all."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the least
    doc_id, null ids last, then the first of its rows.  Texts without words are copies of
    each other."""
    return jaccard_join.one_per_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; without items, all."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs)


def hierarchical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null or empty text is one
    piece of its end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("packing", hierarchical_packing),
]
#: Tokenizer ids, trees and kernels are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again.  What a stage
    has written for itself is deleted when its result is there, and a result when that of
    the next stage is; only the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{number}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
