"""Files to pages: text, Markdown and, where a reader is installed, PDF. One bad file gives an error row, not a failed job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.chunking import without_headers

EMPTY = "The file is empty."
UNSUPPORTED = "Unsupported file type: a PDF, .txt or .md is needed."
PROTECTED = "This PDF is protected by a password."
CORRUPT = "This file could not be read; it looks corrupt or is no valid PDF."
NO_PAGES = "This PDF has no pages."
SCANNED = "No readable text found; this is probably a scanned PDF."
UNREADABLE = "No readable text found in this file."
MIN_PDF_CHARS = 200


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(name, content) of the files below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


#: Bytes for each core below which a table of fewer files than cores is dealt out anew.
SPREAD_BYTES = 32 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table of a few files, which a few tasks would read, over all cores; larger ones as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if len(table.inputFiles()) < cores and size < cores * SPREAD_BYTES else table


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the PDF files of a folder, sorted."""
    return read_files(spark, path, "*.pdf").select("name").orderBy("name")


def decoded(content: str = "content"):
    """The text of bytes: UTF-8 if they are valid, else Latin-1."""
    return F.expr(f"case when is_valid_utf8(cast({content} as string)) then cast({content} as string) else decode({content}, 'ISO-8859-1') end")


def _pdf_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        from pypdf import PdfReader
    except ImportError:
        PdfReader = None
    import io

    for frame in frames:
        rows = []
        for doc, content in zip(frame.doc_id, frame.content):
            try:
                if PdfReader is None:
                    raise ValueError("no PDF reader is installed")
                reader = PdfReader(io.BytesIO(content))
                if reader.is_encrypted and not reader.decrypt(""):
                    rows.append((doc, 0, None, PROTECTED))
                    continue
                pages = [page.extract_text() or "" for page in reader.pages]
                rows += [(doc, i, text, None) for i, text in enumerate(pages, 1)] or [(doc, 0, None, NO_PAGES)]
            except Exception:  # a damaged file can raise anything; it becomes a row
                rows.append((doc, 0, None, CORRUPT))
        yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"])


def extracted(files: DataFrame, pdf_pages=_pdf_pages) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of (doc_id, name, content): (doc_id, page, text) and (doc_id, name, error).

    pdf_pages turns frames of (doc_id, content) into frames of (doc_id, page, text, error).
    """
    lower = F.lower("name")
    kind = F.when(lower.rlike(r"\.(txt|md)$"), "text").when(lower.endswith(".pdf"), "pdf")
    files = files.withColumn("kind", kind)
    bad = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, EMPTY).when(F.col("kind").isNull(), UNSUPPORTED)
    errors = files.select("doc_id", "name", bad.alias("error")).where("error is not null")
    good = files.where("length(content) > 0")
    texts = good.where("kind = 'text'").withColumn("text", decoded()).withColumn("text", F.expr(T.clean("text")))
    texts = texts.select("doc_id", F.posexplode(F.expr(T.pages("text"))).alias("page", "text")).withColumn("page", F.col("page") + 1)
    raw = good.where("kind = 'pdf'").select("doc_id", "content").mapInPandas(pdf_pages, "doc_id long, page int, text string, error string")
    pdfs = without_headers(raw.where("error is null").withColumn("text", F.expr(T.clean("text"))).select("doc_id", "page", "text"))
    sizes = pdfs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    short = sizes.where(f"n < {MIN_PDF_CHARS}").select("doc_id", F.lit(SCANNED).alias("error"))
    failed = raw.where("error is not null").select("doc_id", "error").unionAll(short)
    pages = texts.unionByName(pdfs.join(short, "doc_id", "left_anti"))
    return pages, errors.unionByName(failed.join(files.select("doc_id", "name"), "doc_id").select("doc_id", "name", "error"))
