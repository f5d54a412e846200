"""Structured Streaming: new documents to chunks and postings, and messages to the latest question (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T


def stream_chunks(docs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Chunks (doc_id, page, pos, text) of a stream (doc_id, text, at); equal texts within the watermark count once."""
    new = docs.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256)).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["sha256"])
    pages = new.withColumn("text", F.expr(T.clean("coalesce(text, '')"))).select("doc_id", F.posexplode(F.expr(T.pages("text"))).alias("page", "text"))
    return pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.expr(T.chunks("text"))).alias("pos", "text")).where(F.expr(T.citation_marks("text")) < 3)


def stream_term_counts(docs: DataFrame, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """(window, term, n) of the terms that arrive in each window."""
    terms = docs.withWatermark("at", watermark).select("at", F.explode(F.expr(T.terms("text"))).alias("term"))
    return terms.groupBy(F.window("at", window), "term").agg(F.count("*").alias("n"))
