"""Language-model phrasing behind one interface; a client is any object with complete(system, messages) -> str.

Clients run inside Python workers and must be picklable. No client is needed for local answers.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.words import NOT_FOUND

SYSTEM = "Answer only from the numbered passages. Put the tag of the passage, such as [P2], after each statement. If the passages don't hold the answer, write only NOT_IN_DOCUMENT. Add nothing of your own, and stay brief."


class PhrasingError(Exception):
    """A model that can't be reached or gives no answer; its text is shown as a note."""


class NotConfigured(PhrasingError):
    """A mode was asked for that no client serves; raised before any work is done."""

    HINTS = {
        "local": "Works without settings: sentences of the documents are quoted.",
        "anthropic": "It needs ANTHROPIC_API_KEY.",
        "openai": "It needs LLM_API_KEY, or LLM_BASE_URL for a server without keys.",
    }

    def __init__(self, mode: str):
        super().__init__(f"The mode '{mode}' isn't configured. {self.HINTS.get(mode, '')}".strip())
        self.mode = mode


def resolve(mode: str | None, clients: dict) -> str:
    """The mode to use: auto, empty and None take anthropic, then openai, then any other client, else local."""
    mode = (mode or "auto").lower()
    if mode == "auto":
        return next((m for m in ("anthropic", "openai", *clients) if m in clients), "local")
    if mode != "local" and mode not in ("anthropic", "openai") and mode not in clients:
        raise PhrasingError(f"Unknown mode '{mode}'.")
    if mode != "local" and mode not in clients:
        raise NotConfigured(mode)
    return mode


def http_error(status: int) -> str | None:
    """What to tell for an HTTP status, or None if it is fine."""
    if status in (401, 403):
        return "The model refused the key."
    if status == 429:
        return "The model's rate limit is reached."
    return f"The model answered with status {status}." if status >= 400 else None


def cited(reply: str) -> str:
    """SQL of the distinct passage tags of a reply, in order."""
    return f"array_distinct(regexp_extract_all({reply}, '\\\\[(P[0-9]+)\\\\]', 1))"


def declined(reply: str) -> str:
    return f"startswith(upper(trim({reply})), 'NOT_IN_DOCUMENT')"


def prompts(gated: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(qid, mode, prompt, turns) of the questions that go to a model."""
    ready = gated.where("mode <> 'local' and size(p) > 0 and tier <> 'none'")
    shown = "array_join(transform(p, q -> concat('[P', q.n, '] (', q.doc_name, ', page ', q.page, ')\n', q.text)), '\n\n')"
    ready = ready.select("qid", "mode", "scope", F.expr(f"concat('PASSAGES:\n', {shown}, '\n\nQUESTION: ', question)").alias("prompt"))
    if turns is None:
        return ready.withColumn("turns", F.expr("cast(array() as array<struct<nr:int,role:string,content:string>>)")).drop("scope")
    packed = turns.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("nr", "role", "content"))).alias("turns"))
    return ready.join(packed, "scope", "left").drop("scope")


def phrased(gated: DataFrame, clients: dict, turns: DataFrame | None = None) -> DataFrame:
    """(qid, reply, tags, error, ms): a declined reply becomes the fixed refusal without tags; ms is the model's time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for qid, mode, prompt, before in zip(frame.qid, frame["mode"], frame.prompt, frame.turns):
                began, reply, failed = time.perf_counter(), None, None
                talk = [{"role": t["role"], "content": t["content"]} for t in (before if before is not None else ())]
                try:
                    reply = clients[mode].complete(SYSTEM, [*talk, {"role": "user", "content": prompt}])
                except PhrasingError as error:
                    failed = str(error)
                rows.append((qid, reply, failed, round((time.perf_counter() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["qid", "reply", "error", "ms"])

    out = prompts(gated, turns).mapInPandas(run, "qid long, reply string, error string, ms long")
    out = out.withColumn("error", F.when(F.trim("reply") == "", "The model gave an empty answer.").otherwise(F.col("error")))
    no = F.expr(declined("reply"))
    return out.select("qid", F.when(no, NOT_FOUND).otherwise(F.col("reply")).alias("reply"), F.when(no, F.expr("cast(array() as array<string>)")).otherwise(F.expr(cited("reply"))).alias("tags"), "error", "ms")


SUMMARY_SYSTEM = "Summarise the document from the text given and nothing else: first an overview of 60 words at most, then four or five lines that begin with a bullet."


def summarised(bodies: DataFrame, client) -> DataFrame:
    """(doc_id, summary) of (doc_id, body); null where the model fails, so that the caller falls back silently.

    A client may offer for_summaries(): the client to ask for them.
    """
    client = client.for_summaries() if hasattr(client, "for_summaries") else client

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, body in zip(frame.doc_id, frame.body):
                try:
                    rows.append((doc, client.complete(SUMMARY_SYSTEM, [{"role": "user", "content": f"QUESTION: summarise this document.\n\n{body}"}]).strip() or None))
                except PhrasingError:
                    rows.append((doc, None))
            yield pd.DataFrame(rows, columns=["doc_id", "summary"])

    return bodies.mapInPandas(run, "doc_id long, summary string")
