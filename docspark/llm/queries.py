"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Key of the pseudonyms in these queries; a deployment passes its own secret.
PII_KEY = "corpus key for tests"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.licenses import licenses

    return licenses(_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.pii import pseudonymised

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymised(docs, PII_KEY, found_col="n_found", changed_col="n_replaced")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.fingerprints import fingerprints

    return fingerprints(_documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.mixing import mixed

    return mixed(_documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.language_id import languages

    return languages(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.passage_dedup import repeated_passages

    kept = repeated_passages(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docspark.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.decontaminate import contaminated

    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docspark.llm.suffix_tree import suffix_tree_scores

    return suffix_tree_scores(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from docspark.llm import mixing, passage_dedup

    return {"op4_source_mixing": mixing.SQL, "op7_substring_dedup": passage_dedup.SQL}
