"""The registered queries of this subpackage, over the whole tables of a data directory."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import (
    encoding,
    exact_dedup,
    filter_audit,
    language,
    licenses,
    packing,
    quality,
    secret_scan,
    simhash,
    spelling,
    substrings,
    token_counts,
    topk,
)
from shopfloor.llm.oracle import AUDIT_SQL, DEDUP_SQL, QUALITY_SQL, TOPK_SQL

Query = Callable[[SparkSession, str], DataFrame]

SEQUENCE_TOKENS, OVER_LIMIT = 2048, 1024
SHINGLE_WORDS, MAX_BITS = 3, 2
TOP_K, VECTOR_SCALE, EVERY_QUERY = 5, 256, 50
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"
#: The folder of the vocabulary files; by default that of the installed package.
VOCABULARIES = "SHOPFLOOR_VOCABULARIES"


def vocabulary(name: str) -> str:
    if folder := os.environ.get(VOCABULARIES):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir)).drop("detections")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.Model(language.training_sample(docs, HELD_OUT))
    held_out = F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out")
    return language.predict(docs, model, [held_out])


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), pattern(), SEQUENCE_TOKENS, 0)
    return packing.pack(pieces, SEQUENCE_TOKENS)


def bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), pattern(), with_digests=True)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_documents(spark, sf_dir), null_ids=True).drop("text_key")


def top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_query = F.col("id") % EVERY_QUERY == 0
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), is_query, TOP_K, VECTOR_SCALE)


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), pattern(), OVER_LIMIT)


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    return secret_scan.scan_secrets(_documents(spark, sf_dir), forest)


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), SHINGLE_WORDS, MAX_BITS)


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_documents(spark, sf_dir)))


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return filter_audit.filter_audit(_documents(spark, sf_dir), labels, F.col("source"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).drop("text_key")


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": license_scan,
        "op2_language_id": language_id,
        "op3_best_fit_packing": best_fit_packing,
        "op4_bpe_encoding": bpe_encoding,
        "op5_quality_rules": quality_rules,
        "op6_suffix_dedup": suffix_dedup,
        "op7_top_k": top_k_search,
        "op8_token_counts": token_count,
        "op9_secret_scan": secret_findings,
        "op10_simhash": simhash_components,
        "op11_spelling_variants": spelling_variants,
        "op12_filter_audit": filter_interactions,
        "op13_exact_dedup": exact_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say the same; the tests hold the others against brute force or the libraries."""
    return {
        "op5_quality_rules": QUALITY_SQL,
        "op7_top_k": TOPK_SQL,
        "op12_filter_audit": AUDIT_SQL,
        "op13_exact_dedup": DEDUP_SQL,
    }
