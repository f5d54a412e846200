"""A training-corpus pipeline of five stages over `documents`, each on what the stage before has kept.

language   (6)  keeps texts whose language is recognised: prediction not `und`, score of MIN_SCORE or more
near_dups  (5)  keeps one document, the one with the smallest id, of each group of near duplicates
benchmark  (9)  keeps documents without a benchmark passage
pii        (2)  replaces personal data by pseudonyms in all documents
mixing     (4)  keeps the documents of which the mix takes words, with source target and words taken

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows without an id aren't near duplicates of others. Null texts, empty tables and repeated rows are as in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.decontaminate import decontaminated
from docspark.llm.language_id import is_held_out, learned, recognised
from docspark.llm.mixing import mixed_rows
from docspark.llm.near_dedup import near_duplicates
from docspark.llm.pii import pseudonymised
from docspark.llm.scratch import Scratch

MIN_SCORE = 0.5
PII_KEY = "corpus key for tests"


def _matching(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is in `ids` (doc_id), a missing id included; columns and repeated rows stay."""
    ids = ids.select(F.col("doc_id").alias("_kept_doc_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_doc_id"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = docs.where(~is_held_out(docs["doc_id"])).select(docs["doc_id"].alias("id"), "text", "lang")
    model = learned(train, Scratch(spark))
    return recognised(docs, model, MIN_SCORE)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _matching(docs, near_duplicates(docs.select("doc_id", "text")).where("kept"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymised(docs, PII_KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


STAGES = [("language", language), ("near_dups", near_dups), ("benchmark", benchmark), ("pii", pii), ("mixing", mixing)]

#: SQL can't express these stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
