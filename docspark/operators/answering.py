"""Gated questions to answers: extractive sentences, sources, technical details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.words import NOT_FOUND

_TAGGED = "transform(p, q -> named_struct('id', concat('P', q.n), 'doc_id', q.doc_id, 'doc_name', q.doc_name, 'page', q.page, 'text', q.text, 'score', q.score, 'highlights', {marks}, 'cited', array_contains(used, concat('P', q.n)), 'weak', status <> 'grounded', 'n', q.n))"


def extracted(gated: DataFrame) -> DataFrame:
    """Adds found and used: up to three sentences of the first five passages as bullets with tags.

    Sentences of 30 to 420 characters, at least 0.7 of them letters, without citation marks, weigh the sum of their terms'
    idf over the fourth root of their length; those below 0.55 of the best and repeats are left out.
    """
    good = f"length(s.text) between 30 and 420 and {T.letter_share('s.text')} >= 0.7 and {T.citation_marks('s.text')} = 0"
    weight = "aggregate(filter(w, x -> array_contains(s.terms, x.term)), 0D, (a, x) -> a + x.idf) / power(length(s.text), 0.25D)"
    rows = f"flatten(transform(slice(p, 1, 5), q -> transform(filter(transform(q.sentences, (s, i) -> named_struct('text', s.text, 'terms', s.terms, 'i', i)), s -> {good}), s -> named_struct('a', -({weight}), 'b', -q.score, 'n', q.n, 'i', s.i, 'text', s.text, 'key', {T.dedupe_key('s.text')}))))"
    out = gated.withColumn("cands", F.expr(f"array_sort({rows})"))
    take = "if(size(a.n) < 3 and c.a <= 0.55D * cands[0].a and not array_contains(a.keys, c.key), named_struct('keys', concat(a.keys, array(c.key)), 'n', concat(a.n, array(concat('P', c.n))), 'lines', concat(a.lines, array(concat('• ', c.text, ' [P', c.n, ']')))), a)"
    empty = "named_struct('keys', cast(array() as array<string>), 'n', cast(array() as array<string>), 'lines', cast(array() as array<string>))"
    chosen = f"if(size(cands) = 0 or get(cands, 0).a >= 0, {empty}, aggregate(cands, {empty}, (a, c) -> {take}))"
    out = out.withColumn("chosen", F.expr(chosen))
    return out.withColumn("found", F.expr("nullif(array_join(chosen.lines, '\n'), '')")).withColumn("used", F.col("chosen.n")).drop("cands", "chosen")


#: The rule that gives a question its tier, in words.
GATE_RULE = "high: a passage holds 0.6 of the weight of the terms, or a sentence 0.5; low: 0.2; else none"
SUMMARY_RULE = "a summary was asked for: the stored one is the answer, nothing is searched"
NO_MODEL = "none (no LLM used)"


def answered(gated: DataFrame, phrased: DataFrame | None = None, models: dict[str, str] | None = None) -> DataFrame:
    """(qid, answer, status, mode, sources, coverage, note, tech) of gated questions with a column mode (resolved).

    phrased: (qid, reply, tags, error, ms) of the questions that a model phrased; an error falls back to sentences with a
    note. models: the model of each mode.
    Refused are questions without passages, with tier none, and in local mode without the statistic asked for.
    """
    out = extracted(gated)
    if phrased is None:
        out = out.withColumns({"reply": F.lit(None).cast("string"), "tags": F.expr("cast(null as array<string>)"), "error": F.lit(None).cast("string"), "ms": F.lit(None).cast("long")})
    else:
        out = out.join(phrased, "qid", "left")
    refused = (F.size("p") == 0) | (F.col("tier") == "none") | ((F.col("mode") == "local") & ~F.col("stat_ok"))
    by_model = ~refused & (F.col("mode") != "local") & F.col("error").isNull() & F.col("reply").isNotNull()
    out = out.withColumn("refused", refused).withColumn("by_model", by_model)
    out = out.withColumn("answer", F.when(F.col("refused"), NOT_FOUND).when(F.col("by_model"), F.col("reply")).otherwise(F.coalesce("found", F.lit(NOT_FOUND))))
    out = out.withColumn("used", F.when(F.col("answer") == NOT_FOUND, F.expr("cast(array() as array<string>)")).when(F.col("by_model"), F.col("tags")).otherwise(F.col("used")))
    out = out.withColumn("status", F.when(F.col("answer") == NOT_FOUND, "not_found").when(~F.col("by_model") & (F.col("tier") == "low"), "low_confidence").otherwise("grounded"))
    out = out.withColumn("used_mode", F.when(F.col("by_model"), F.col("mode")).otherwise("extractive"))
    sources = _TAGGED.format(marks=T.highlights("q.text", "terms"))
    out = out.withColumn("sources", F.expr(sources))
    order = "array_sort(sources, (l, r) -> case when status = 'grounded' and l.cited <> r.cited then if(l.cited, -1, 1) else l.n - r.n end)"
    out = out.withColumn("sources", F.expr(f"transform({order}, s -> named_struct('id', s.id, 'doc_id', s.doc_id, 'doc_name', s.doc_name, 'page', s.page, 'text', s.text, 'score', s.score, 'highlights', s.highlights, 'cited', s.cited, 'weak', s.weak))"))
    called = ~F.col("refused") & (F.col("mode") != "local")
    model = F.lit(NO_MODEL)
    for mode, name in (models or {}).items():
        model = F.when(F.col("by_model") & (F.col("mode") == mode), name).otherwise(model)
    tech = F.struct(
        F.col("mode").alias("requested_mode"),
        F.when(F.col("by_model"), F.col("mode")).otherwise("extractive (local)").alias("answer_engine"),
        model.alias("model"),
        F.col("terms").alias("query_terms"),
        F.col("searched").alias("chunks_searched"),
        F.size("p").alias("passages_retrieved"),
        F.expr("transform(p, q -> named_struct('id', concat('P', q.n), 'page', q.page, 'bm25', q.score))").alias("top_scores"),
        F.struct("tier", "coverage", F.col("stat_ok").alias("statistic_check"), F.lit(GATE_RULE).alias("rule")).alias("gate"),
        called.alias("llm_called"),
        F.struct(F.col("ms").alias("llm")).alias("timing_ms"),
        F.when(called, 0).alias("temperature"),
    )
    note = F.when(~F.col("refused") & F.col("error").isNotNull(), F.concat("error", F.lit(" Showing an extractive answer instead.")))
    return out.select("qid", "answer", "status", F.col("used_mode").alias("mode"), "sources", "coverage", note.alias("note"), tech.alias("tech"))


def summary_answers(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, answer, status, mode, coverage, sources, note, tech): the stored summaries of the scope in the order of
    documents, named if there are several. asked: (qid, scope, mode).
    """
    own = documents.select(F.col("doc_id").cast("string").alias("scope"), F.col("summary").alias("answer"))
    every = documents.agg(F.array_sort(F.collect_list(F.struct("doc_id", "name", "summary"))).alias("d")).where("size(d) > 0")
    text = F.expr("array_join(transform(d, x -> if(size(d) = 1, x.summary, concat(x.name, '\n', x.summary))), '\n\n')")
    stored = own.unionAll(every.select(F.lit("all").alias("scope"), text.alias("answer")))
    found = asked.select("qid", "scope", "mode").join(stored, "scope", "left")
    tech = F.struct(
        F.col("mode").alias("requested_mode"),
        F.lit("stored document summary").alias("answer_engine"),
        F.lit("n/a (generated at upload)").alias("model"),
        F.expr("cast(array() as array<string>)").alias("query_terms"),
        F.lit(0).cast("long").alias("chunks_searched"),
        F.lit(0).alias("passages_retrieved"),
        F.expr("cast(array() as array<struct<id:string,page:int,bm25:double>>)").alias("top_scores"),
        F.struct(F.lit("high").alias("tier"), F.lit(1.0).alias("coverage"), F.lit(True).alias("statistic_check"), F.lit(SUMMARY_RULE).alias("rule")).alias("gate"),
        F.lit(False).alias("llm_called"),
        F.struct(F.lit(None).cast("long").alias("llm")).alias("timing_ms"),
        F.lit(None).cast("int").alias("temperature"),
    )
    return found.select("qid", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), F.lit("grounded").alias("status"), F.lit("extractive").alias("mode"), F.lit(1.0).alias("coverage"), F.lit(None).cast("string").alias("note"), tech.alias("tech"))
