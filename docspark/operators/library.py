"""The library's tables against one another: names, totals, deletes, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds doc_name to rows with doc_id, from (doc_id, name)."""
    return rows.join(documents.select("doc_id", F.col("name").alias("doc_name")), "doc_id")


def totals(pages: DataFrame) -> DataFrame:
    """(documents, pages, chars) of (doc_id, page, text)."""
    return pages.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in `gone`: what a delete leaves, and the samples that aren't in the library yet."""
    return rows.join(gone.select("doc_id"), "doc_id", "left_anti")
