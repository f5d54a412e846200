"""Inverted index: postings, lengths and scope statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T

K1, B = 1.4, 0.75


def postings(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, term, tf), of all terms or of those in `only` (term), which are picked before anything is shuffled."""
    words = chunks.select("doc_id", "idx", F.explode(F.expr(T.terms("text"))).alias("term"))
    words = words if only is None else words.join(only, "term", "left_semi")
    return words.groupBy("doc_id", "idx", "term").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(doc_id, idx, len): chunks without a term stay, with 0."""
    return chunks.select("doc_id", "idx", F.expr(f"cast(size({T.content_tokens('text')}) as bigint)").alias("len"))


def scope_stats(sizes: DataFrame) -> DataFrame:
    """(scope, n, avg): of all chunks, scope `all`, and of each document."""
    grouped = sizes.groupingSets([["doc_id"], []], "doc_id").agg(F.count("*").alias("n"), F.avg("len").alias("avg"), F.grouping_id().alias("g"))
    return grouped.select(F.when(F.col("g") > 0, "all").otherwise(F.col("doc_id").cast("string")).alias("scope"), "n", F.coalesce("avg", F.lit(0.0)).alias("avg"))


def vocabulary(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, term, df, idf) for scope `all` and each document."""
    df = index.groupingSets([["doc_id", "term"], ["term"]], "doc_id", "term").agg(F.count("*").alias("df"), F.grouping_id().alias("g"))
    df = df.select(F.when(F.col("g") > 0, "all").otherwise(F.col("doc_id").cast("string")).alias("scope"), "term", "df")
    return df.join(stats.select("scope", "n"), "scope").select("scope", "term", "df", idf().alias("idf"))


def idf():
    return F.expr("ln(1 + (n - df + 0.5D) / (df + 0.5D))")
