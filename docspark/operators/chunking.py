"""Pages to passages: running headers, chunks, exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T


def paged(docs: DataFrame, size: int = 3000) -> DataFrame:
    """(doc_id, page, text) of cleaned texts in slices of `size` characters; page numbers from 1."""
    pages = docs.withColumn("text", F.expr(T.clean("coalesce(text, '')"))).select("doc_id", F.posexplode(F.expr(T.pages("text", size))).alias("page", "text"))
    return pages.withColumn("page", F.col("page") + 1)


def without_headers(pages: DataFrame) -> DataFrame:
    """Pages without the lines that more than 40 % of a document's pages repeat, for documents of four pages or more.

    Lines are compared stripped, lower-cased and with numbers as #; those of three characters or fewer stay.
    """
    lines = pages.select("doc_id", "page", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n")).alias("nr", "line"))
    lines = lines.withColumn("key", F.regexp_replace(F.lower(F.expr(T.strip("line"))), r"\p{Nd}+", "#"))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    bad = lines.where("length(key) > 3").select("doc_id", "page", "key").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    bad = bad.join(size, "doc_id").where("pages >= 4 and n > 0.4 * pages").select("doc_id", "key")
    kept = lines.join(bad, ["doc_id", "key"], "left_anti").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("nr", "line"))).alias("l"))
    return pages.select("doc_id", "page").join(kept, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce(F.expr("array_join(l.line, '\n')"), F.lit("")).alias("text"))


def chunked(pages: DataFrame) -> DataFrame:
    """(doc_id, idx, page, text): chunks of pages without reference lists, numbered from 0 within a document."""
    parts = pages.select("doc_id", "page", F.posexplode(F.expr(T.chunks("text"))).alias("pos", "text")).where(F.expr(T.citation_marks("text")) < 3)
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1
    return parts.select("doc_id", idx.alias("idx"), "page", "text")


def first_copies(docs: DataFrame, content: str = "text", order: str = "doc_id") -> DataFrame:
    """(order column, sha256, first_id, duplicate): the first of equal contents is kept."""
    hashed = docs.select(order, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    least = hashed.groupBy("sha256").agg(F.min(order).alias("first_id"))
    return hashed.join(least, "sha256").select(order, "sha256", "first_id", (F.col(order) != F.col("first_id")).alias("duplicate"))


def page_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page as its chunks in order, with a blank line between."""
    joined = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return chunks.groupBy("doc_id", "page").agg(joined.alias("c")).select("doc_id", "page", F.expr("array_join(c.text, '\n\n')").alias("text"))
