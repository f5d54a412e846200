"""The whole way from questions to answers as one plan, and from texts to a library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import answering, chunking, phrasing, retrieval, summaries


def library(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, documents): (doc_id, idx, page, text), and (doc_id, pages, n_chunks, summary, keywords), of pages."""
    chunks = chunking.chunked(pages)
    stats = summaries.term_stats(pages)
    words = summaries.keywords(stats).groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, keyword))), x -> x.keyword)").alias("keywords"))
    docs = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"))
    docs = docs.join(chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks")), "doc_id", "left").join(summaries.summaries(pages, stats), "doc_id", "left").join(words, "doc_id", "left")
    return chunks, docs.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("keywords", F.coalesce("keywords", F.expr("cast(array() as array<string>)")))


def gated(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions (qid, scope, question, previous, mode) with their passages and gate; chunks have doc_name."""
    asked = retrieval.understood(questions)
    asked = asked.where("not summary")
    passages, weights, stats, docs = retrieval.searched(asked, chunks)
    if docs is not None:  # only these documents are read and cut again for the passages' texts
        chunks = chunks.where(F.col("doc_id").isin(docs))
    searched = asked.select("qid", "scope").join(stats, "scope").select("qid", F.col("n").alias("searched"))
    return retrieval.gated(asked, passages, weights, chunks).join(searched, "qid", "left").withColumn("searched", F.coalesce("searched", F.lit(0)))


def answers(questions: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, clients: dict | None = None, turns: DataFrame | None = None) -> DataFrame:
    """(qid, answer, status, mode, coverage, note, sources, tech) of every question."""
    ready = gated(questions, chunks)
    phrased = phrasing.phrased(ready, clients, turns) if clients else None
    out = answering.answered(ready, phrased, {mode: getattr(client, "model", mode) for mode, client in (clients or {}).items()})
    if documents is None:
        return out
    stored = answering.summary_answers(retrieval.understood(questions).where("summary"), documents)
    return out.unionByName(stored, allowMissingColumns=True)
