"""A training corpus from ``documents``: cleaned, near-duplicates and repeats cut, secrets masked, packed.

``run`` applies the stages of ``STAGES`` in order, each to the Parquet table that the
one before has written to the shared folder. All stages read whole texts of any length, take an empty table
to an empty one, and pass on columns that they do not know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfloor.llm import quality, secret_scan, simhash, substrings
from shopfloor.llm.common import written
from shopfloor.llm.queries import MAX_BITS, SHINGLE_WORDS, pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their failing lines; null and empty texts fail, repeated rows are judged alike."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the smallest id (null ids last); of fully repeated rows one."""
    return simhash.one_per_component(docs, SHINGLE_WORDS, MAX_BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus, null ids last; those cut to nothing go."""
    return substrings.without_passages(docs, null_ids=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked, the same rows; null texts stay null."""
    return secret_scan.mask_secrets(docs, secret_scan.train_forest(secret_scan.labelled_findings(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; null text counts as empty, repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: SQL has neither XXH64 with a seed nor the vocabulary; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
