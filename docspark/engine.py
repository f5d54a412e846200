"""A library of documents with questions, answers and history: the calls a program makes."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators import chunking, history, models, phrasing, retrieval, summaries
from docspark.plans import ask
from docspark.sources import files as sources
from docspark.sources.store import Store

MAX_UPLOAD_MB, MAX_QUESTION = 25, 1000
#: What happens to a document and a question, stage by stage.
PIPELINE = [
    {"stage": "Extraction", "tech": "texts, Markdown and PDF pages as SQL expressions; repeated header lines, addresses and citation marks go"},
    {"stage": "Chunking", "tech": "overlapping pieces inside a page; pieces of bibliographies go"},
    {"stage": "Retrieval", "tech": f"BM25 over stems, the best {retrieval.TOP} chunks, up to {retrieval.MOST} with those of other documents"},
    {"stage": "Grounding gate", "tech": "share of the terms' weight, words unknown to the library, statistics asked for"},
    {"stage": "Answer", "tech": "sentences with page references, or a model that cites passages or declines"},
    {"stage": "Storage", "tech": "Parquet tables: documents, chunks, messages; appends add files, a record makes each commit visible at once"},
]


class RequestError(Exception):
    """A request that can't be served, with the status code a service would send."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Engine:
    """clients: the model clients by mode, such as models.configured() gives; samples: a folder of PDF files to offer."""

    def __init__(self, spark: SparkSession, path: str, clients: dict | None = None, samples: str | None = None):
        self.spark, self.store, self.clients, self.samples = spark, Store(spark, path), clients or {}, samples
        self._chunks: DataFrame | None = None

    # library

    def status(self) -> dict:
        default = models.config("auto", self.clients)
        names = [r.name for r in sources.listing(self.spark, self.samples).collect()] if self.samples else []
        found = {"llm_mode": default["mode"], "model": default["model"], "default_mode": default["mode"], "modes": ["local", *self.clients]}
        return found | {"providers": models.providers(self.clients), "documents": self.store.read("documents").count(), "samples": names}

    def system(self) -> dict:
        row = self.store.read("documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).first()
        limits = {"max_upload_mb": MAX_UPLOAD_MB, "max_question": MAX_QUESTION}
        return row.asDict() | limits | {"pipeline": PIPELINE, "providers": models.providers(self.clients)}

    def list_documents(self) -> DataFrame:
        return self.store.read("documents").select("doc_id", "name", "pages", "n_chunks", "summary_mode", "created").orderBy("doc_id")

    def document(self, doc_id: int) -> dict:
        row = self.store.read("documents").where(F.col("doc_id") == doc_id).first()
        if row is None:
            raise RequestError(404, "No such document.")
        return row.asDict()

    def page_text(self, doc_id: int, page: int) -> str:
        row = chunking.page_text(self.store.read("chunks").where((F.col("doc_id") == doc_id) & (F.col("page") == page))).first()
        if row is None:
            raise RequestError(404, "No such page.")
        return row.text

    def ingest(self, files: DataFrame, mode: str | None = "local", pdf_pages=sources._pdf_pages) -> DataFrame:
        """Adds files (name, content) and returns (name, doc_id, duplicate, error) of each.

        Ids follow the order of names and contents. Files equal to one another or to stored ones are duplicates of the first,
        whatever the mode; new files need a mode that is configured. Empty files and files without content give an error row
        each, files without a name are named "".
        """
        hashed = files.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("content", F.lit(bytearray())).alias("content"))
        hashed = hashed.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.length("content"))
        # the order of all files takes one task: only names and hashes go there, contents are joined below
        named = hashed.select("name", "sha256", "size").withColumn("nr", F.row_number().over(Window.orderBy("name", "sha256")))
        stored = self.store.read("documents").select("sha256", F.col("doc_id").alias("known"))
        first = named.groupBy("sha256").agg(F.min("nr").alias("first"))
        base = self.store.next_id("documents") - 1
        full = named.join(first, "sha256").join(stored, "sha256", "left").withColumn("doc_id", F.coalesce("known", F.col("first") + base).cast("long"))
        full = full.withColumn("duplicate", (F.col("size") > 0) & (F.col("known").isNotNull() | (F.col("nr") != F.col("first"))))
        full = full.persist()
        contents = hashed.select("name", "sha256", "content").dropDuplicates(["name", "sha256"])
        fresh = full.where("not duplicate").join(contents, ["name", "sha256"]).persist()
        large = fresh.where(f"size > {MAX_UPLOAD_MB} * 1048576").select("doc_id", "name", F.lit("The file is too large.").alias("error"))
        mode = phrasing.resolve(mode, self.clients) if not fresh.isEmpty() else "local"
        pages, errors = sources.extracted(fresh.where(f"size <= {MAX_UPLOAD_MB} * 1048576").select("doc_id", "name", "content"), pdf_pages)
        pages, errors = pages.persist(), errors.unionByName(large)
        chunks, docs = ask.library(pages)
        none = docs.where("n_chunks = 0").join(fresh.select("doc_id", "name"), "doc_id").select("doc_id", "name", F.lit(sources.UNREADABLE).alias("error"))
        errors = errors.unionByName(none).persist()
        rows = docs.where("n_chunks > 0").join(fresh.select("doc_id", "name", "sha256"), "doc_id").withColumn("summary_mode", F.lit("extractive")).withColumn("created", F.current_timestamp())
        if mode != "local":
            told = phrasing.summarised(summaries.summary_prompts(pages), self.clients[mode]).withColumnRenamed("summary", "told")
            rows = rows.join(told, "doc_id", "left").withColumn("summary_mode", F.when(F.col("told").isNotNull(), mode).otherwise(F.col("summary_mode"))).withColumn("summary", F.coalesce("told", "summary"))
        self.store.append(chunks=chunks.join(fresh.select("doc_id", F.col("name").alias("doc_name")), "doc_id"), documents=rows)
        self.invalidate()
        failed = errors.select("doc_id", "error").dropDuplicates(["doc_id"])
        out = full.join(failed, "doc_id", "left").select("name", F.when(F.col("error").isNull(), F.col("doc_id")).alias("doc_id"), "duplicate", "error").orderBy("name")
        out = self.spark.createDataFrame(out.collect(), out.schema)  # one short row per file of this call
        for frame in (full, fresh, pages, errors):
            frame.unpersist()
        return out

    def load_sample(self, name: str, mode: str | None = "auto") -> dict:
        """Adds a file of the samples' folder, named by its bare name, and returns its document with `duplicate`."""
        if not self.samples or not name.endswith(".pdf") or sources.listing(self.spark, self.samples).where(F.col("name") == name).isEmpty():
            raise RequestError(404, "No such sample.")
        files = sources.read_files(self.spark, self.samples, "*.pdf").where(F.col("name") == name)
        try:
            row = self.ingest(files, mode).first()
        except phrasing.NotConfigured as error:
            raise RequestError(409, str(error)) from error
        if row.error:
            raise RequestError(422, row.error)
        return self.document(row.doc_id) | {"duplicate": row.duplicate}

    def delete_document(self, doc_id: int) -> None:
        if not self.store.delete_document(doc_id):
            raise RequestError(404, "No such document.")
        self.invalidate()

    def invalidate(self) -> None:
        if self._chunks is not None:
            self._chunks.unpersist()
        self._chunks = None

    # questions

    def _scope(self, scope) -> str:
        scope = "all" if scope in (None, "", "all") else str(scope)
        if scope != "all" and (not scope.isdigit() or self.store.read("documents").where(F.col("doc_id") == int(scope)).isEmpty()):
            raise RequestError(404, "No such document.")
        return scope

    def ask(self, question: str, scope="all", mode: str | None = "auto") -> dict:
        """One question, with history; see ask_all for many."""
        documents = self.store.read("documents")
        if documents.isEmpty():
            raise RequestError(409, "Add a document first.")
        question = (question or "").strip()
        if not question or len(question) > MAX_QUESTION:
            raise RequestError(400, "The question is empty or too long.")
        scope = self._scope(scope)
        try:
            mode = phrasing.resolve(mode, self.clients)
        except phrasing.NotConfigured as error:
            raise RequestError(409, str(error)) from error
        except phrasing.PhrasingError as error:
            raise RequestError(400, str(error)) from error
        messages = self.store.read("messages").where(F.col("scope") == scope)
        before = history.previous_questions(messages).first()
        rows = self.spark.createDataFrame([(1, scope, question, before.previous if before else None, mode)], "qid long, scope string, question string, previous string, mode string")
        began = time.perf_counter()
        answer = self.ask_all(rows, history.turns(messages)).first().asDict(recursive=True)
        total, phrased = round((time.perf_counter() - began) * 1000), answer["tech"]["timing_ms"]["llm"]
        answer["tech"]["timing_ms"] = {"retrieval": total - (phrased or 0), "llm": phrased, "total": total}
        at = self.store.next_id("messages")
        meta = json.dumps({k: v for k, v in answer.items() if k not in ("qid", "answer")}, default=str)
        added = self.spark.createDataFrame([(at, scope, "user", question, None), (at + 1, scope, "assistant", answer["answer"], meta)], "id long, scope string, role string, content string, meta string")
        self.store.append(messages=added.withColumn("created", F.current_timestamp()))
        return answer

    def ask_all(self, questions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
        """Answers of (qid, scope, question, previous, mode); modes are resolved, scopes valid."""
        if self._chunks is None:
            self._chunks = self.store.read("chunks").persist()
        return ask.answers(questions, self._chunks, self.store.read("documents"), self.clients, turns)

    def history(self, scope="all", limit: int = 100) -> DataFrame:
        scope = self._scope(scope)
        return history.latest(self.store.read("messages").where(F.col("scope") == scope), limit).orderBy("id")

    def clear_history(self, scope="all") -> None:
        self.store.replace(messages=history.without_scope(self.store.read("messages"), str(scope)))
