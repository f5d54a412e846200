"""Questions to ranked passages and the grounding gate, for any number of questions in one plan."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

from docspark.functions import text as T
from docspark.functions.words import SUMMARY_STEMS, SUMMARY_WORDS
from docspark.operators import index, search
from docspark.operators.index import B, K1, idf

TOP, MOST, FLOOR = 6, 8, 0.4
FOLLOW_UP = r"(?i)\b(it|its|they|their|them|this|that|those|these|he|she|there|one|ones|also|more)\b"
STATISTIC = r"(?i)\b(percent|percentage|percentages|statistic|statistics|proportion|rate of|fraction|share of)\b"
_SUMMARY = T.words_in(dict.fromkeys([*map(T.stemmed, SUMMARY_WORDS), *SUMMARY_STEMS]))
#: Distinct terms of a batch of questions that are looked up in the texts word by word; more are joined after a shuffle.
MOST_TERMS = 100_000
#: Terms of a batch, each counted for every question that has it, that are held by the driver and by each task.
MOST_PARTS = 1_000_000
#: Documents whose texts are looked up by a condition that goes down to the scan; more are joined.
MOST_DOCS = 10_000


def understood(questions: DataFrame) -> DataFrame:
    """Adds terms, proper and summary (whether the stored summary is asked for) to (qid, scope, question, previous).

    A question with fewer than two terms, or fewer than four and a pronoun, takes the terms of the previous one too.
    """
    out = questions.withColumn("raw", F.expr(T.query_terms("question")))
    out = out.withColumn("own", F.expr(f"filter(raw, t -> t not in {_SUMMARY})"))
    follows = (F.size("own") < 2) | ((F.size("own") < 4) & F.col("question").rlike(FOLLOW_UP))
    out = out.withColumn("terms", F.when(F.col("previous").isNotNull() & follows, F.expr(f"array_union(own, {T.query_terms('previous')})")).otherwise(F.col("own")))
    asked = F.expr(T.strip("question")).rlike(r"(?i)^\W*tl;?\s?dr\W*$") | ((F.size("raw") > 0) & (F.size("own") == 0))
    return out.withColumn("proper", F.expr(T.proper_terms("question"))).withColumn("summary", asked).drop("raw", "own")


def _each(asked: DataFrame) -> DataFrame:
    """(qid, scope, size, pos, term): terms and proper words of questions together; pos is the place in their union."""
    return asked.select("qid", "scope", F.size("terms").alias("size"), F.posexplode(F.expr("array_union(terms, proper)")).alias("pos", "term"))


def searched(asked: DataFrame, chunks: DataFrame, fill: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, list | None]:
    """(passages, weights, stats, docs) of questions over chunks (doc_id, idx, text): those of `ranked`, (scope, n, avg), and
    the doc_ids of the passages where they are known and MOST_DOCS at most, else None.

    The search is done when this returns, unless the batch is one of more than MOST_TERMS terms or MOST_PARTS pairs of a
    question and a term, or ids are no whole numbers: those are joined by the plan. Without `fill` passages end with the first six.
    """
    each = _each(asked)
    terms, parts = each.agg(F.countDistinct("term"), F.count("*")).first()
    if terms > MOST_TERMS or parts > MOST_PARTS or not all(isinstance(chunks.schema[c].dataType, IntegralType) for c in ("doc_id", "idx")):
        sizes, only = index.lengths(chunks), each.select("term").distinct()
        stats = index.scope_stats(sizes)
        passages, weights = ranked(asked, index.postings(chunks, F.broadcast(only) if terms <= MOST_TERMS else only), sizes, stats)
        return (passages if fill else passages.where(f"n <= {TOP}")), weights, stats, None
    rows = each.collect()
    names = list(dict.fromkeys(r.term for r in rows))
    counts = search.counted(chunks, names).persist()
    try:
        if not counts.groupBy("doc_id", "idx").count().where("count > 1").isEmpty():
            once = search.merged(counts).persist()
            counts.unpersist()
            counts = once
        return _searched(asked, rows, names, counts, fill)
    finally:
        counts.unpersist()


def _searched(asked: DataFrame, rows: list, names: list[str], counts: DataFrame, fill: bool) -> tuple[DataFrame, DataFrame, DataFrame, list | None]:
    """What `searched` returns, as small tables, from counts of the terms `names`; rows: (qid, scope, size, pos, term)."""
    spark = counts.sparkSession
    questions = list(dict.fromkeys((r.qid, r.scope) for r in rows))
    number, code = {q: k for k, q in enumerate(questions)}, {t: k for k, t in enumerate(names)}
    scopes = sorted({r.scope for r in rows if r.scope not in (None, "all")})
    own = counts.withColumn("scope", F.col("doc_id").cast("string")).join(F.broadcast(spark.createDataFrame(pa.table({"scope": pa.array(scopes, pa.string())}))), "scope") if scopes else None
    every = counts.withColumn("scope", F.lit("all"))
    lens = lambda of: of.select("scope", F.explode("lens").alias("len")).groupBy("scope").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    found = lambda of: of.select("scope", F.explode("codes").alias("code")).groupBy("scope", "code").agg(F.count("*").alias("df"))
    stats = {r.scope: (r.n, r.avg or 0.0) for r in (lens(every) if own is None else lens(every).unionAll(lens(own))).collect()}
    df = {(r.scope, r.code): r.df for r in (found(every) if own is None else found(every).unionAll(found(own))).collect()}
    facts = [(df.get((r.scope, code[r.term]), 0), *stats.get(r.scope, (0, 0.0))) for r in rows]
    kind = asked.schema["qid"].dataType
    weights = _local(spark, [(r.qid, r.pos, r.term, *f) for r, f in zip(rows, facts)], StructType([StructField("qid", kind)]), "pos int, term string, df long, n long, avg double").withColumn("idf", idf())
    distinct = list(dict.fromkeys(facts))
    value = dict(zip(distinct, (r.idf for r in _local(spark, [(k, *f) for k, f in enumerate(distinct)], StructType(), "k int, df long, n long, avg double").withColumn("idf", idf()).orderBy("k").collect())))
    parts = [(code[r.term], number[r.qid, r.scope], r.pos, value[f], f[2]) for r, f in zip(rows, facts) if r.pos < r.size and f[0] > 0]
    known = search.Weights(parts, [None if scope == "all" else scope or "" for _, scope in questions])
    top = search.best(counts, known, TOP)
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*_better()))).where(F.col("n") <= TOP).select("q", "n", "doc_id", "idx", "score").collect()
    passages = [tuple(r) for r in top]
    if fill:
        chosen = defaultdict(list)
        for r in top:
            chosen[r.q].append(r)
        floors = [FLOOR * max((r.score for r in chosen[q]), default=0.0) if scope == "all" and chosen[q] else float("inf") for q, (_, scope) in enumerate(questions)]
        # the first documents by id that reach the floor: of those, TOP may be among the first passages
        rest = search.first(counts, known, MOST + TOP, floors)
        rest = rest.withColumn("r", F.row_number().over(Window.partitionBy("q", "doc_id").orderBy(*_better()))).where("r = 1").orderBy("q", "doc_id").select("q", "doc_id", "idx", "score")
        taken = {q: {r.doc_id for r in chosen[q]} for q in range(len(questions))}
        had = {q: len(chosen[q]) for q in range(len(questions))}
        for r in rest.toLocalIterator():
            if r.score >= floors[r.q] and r.doc_id not in taken[r.q] and had[r.q] < MOST:
                had[r.q] += 1
                passages.append((r.q, had[r.q], r.doc_id, r.idx, r.score))
    docs = sorted({p[2] for p in passages})
    ids = StructType([StructField("qid", kind), StructField("n", IntegerType()), counts.schema["doc_id"], counts.schema["idx"]])
    passages = _local(spark, [(questions[q][0], *rest) for q, *rest in passages], ids, "score double")
    stats = _local(spark, [(s, *v) for s, v in stats.items()], StructType(), "scope string, n long, avg double")
    return passages, weights, stats, docs if len(docs) <= MOST_DOCS else None


def _local(spark, rows: list[tuple], first: StructType, others: str) -> DataFrame:
    """A small table of rows that the driver has."""
    schema = StructType([*first.fields, *StructType.fromDDL(others).fields])
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names), schema)


def _better() -> list[Column]:
    return [F.desc(F.round("score", 9)), F.col("doc_id"), F.col("idx")]


def weighed(asked: DataFrame, postings: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, weights): (qid, doc_id, idx, pos, tf) of the chunks with a term, and (qid, pos, term, df, idf, n, avg).

    Terms and proper words are looked up together; pos is the place in their union.
    """
    each = _each(asked).drop("size")
    hits = postings.join(each, "term").where("scope = 'all' or scope = cast(doc_id as string)").select("qid", "scope", "pos", "doc_id", "idx", "tf")
    found = hits.groupBy("qid", "pos").agg(F.count("*").alias("df"))
    weights = each.join(found, ["qid", "pos"], "left").join(stats, "scope", "left")
    weights = weights.select("qid", "pos", "term", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg", F.lit(0.0)).alias("avg"))
    return hits, weights.withColumn("idf", idf())


def ranked(asked: DataFrame, postings: DataFrame, sizes: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, weights): (qid, n, doc_id, idx, score) by BM25, and the weights of the questions' terms.

    The first six chunks, then, in scope `all`, the best chunk of each other document in ascending order while it reaches
    0.4 of the first and there are fewer than eight. Contributions are added in the order of terms; ties go to the earlier chunk.
    """
    hits, weights = weighed(asked, postings, stats)
    own = asked.select("qid", F.size("terms").alias("size"))
    parts = hits.join(own, "qid").where("pos < size").join(weights.select("qid", "pos", "idf", "avg"), ["qid", "pos"]).join(sizes, ["doc_id", "idx"])
    parts = parts.withColumn("part", F.expr(f"idf * tf * {K1 + 1}D / (tf + {K1}D * (1 - {B}D + {B}D * len / if(avg = 0, 1, avg)))"))
    scored = parts.groupBy("qid", "scope", "doc_id", "idx").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    scored = scored.select("qid", "scope", "doc_id", "idx", F.expr("aggregate(parts, 0D, (s, p) -> s + p.part)").alias("score"))
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*_better()))).where(F.col("n") <= TOP)
    first = top.groupBy("qid").agg(F.max("score").alias("best"), F.max("n").alias("had"))
    rest = scored.where("scope = 'all'").join(top.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(*_better()))).where("r = 1").join(first, "qid").where(f"score >= {FLOOR} * best")
    # six of a question's chunks may be had: a limit on n alone is pushed below the shuffle
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).where(f"n < {MOST} and n + had <= {MOST}").withColumn("n", F.col("n") + F.col("had"))
    columns = ["qid", "n", "doc_id", "idx", "score"]
    return top.select(columns).unionByName(rest.select(columns)), weights


def coverage(terms: str) -> str:
    """SQL of the share of the weights w of a question whose terms are in an SQL array."""
    total = "aggregate(w, 0D, (s, x) -> s + x.idf)"
    return f"if({total} = 0, 0D, aggregate(filter(w, x -> array_contains({terms}, x.term)), 0D, (s, x) -> s + x.idf) / {total})"


def gated(asked: DataFrame, passages: DataFrame, weights: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every question with its passages p, weights w, tier, stat_ok and coverage.

    p: array of (n, doc_id, doc_name, page, idx, text, score, terms, sentences of (text, terms)) in order.
    """
    full = passages.join(chunks, ["doc_id", "idx"])
    sents = f"transform({T.sentences('text')}, s -> named_struct('text', s, 'terms', {T.terms('s')}))"
    full = full.select("qid", F.struct("n", "doc_id", "doc_name", "page", "idx", "text", F.round("score", 3).alias("score"), F.expr(T.terms("text")).alias("terms"), F.expr(sents).alias("sentences")).alias("p"))
    full = full.groupBy("qid").agg(F.array_sort(F.collect_list("p"), lambda a, b: (a["n"] - b["n"]).cast("int")).alias("p"))
    known = weights.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "df", "idf"))).alias("v"))
    out = asked.join(known, "qid", "left").join(full, "qid", "left")
    none = full.schema["p"].dataType.simpleString()
    out = out.withColumn("p", F.coalesce("p", F.expr(f"cast(array() as {none})"))).withColumn("v", F.coalesce("v", F.expr("cast(array() as array<struct<pos:int,term:string,df:bigint,idf:double>>)")))
    out = out.withColumn("w", F.expr("filter(v, x -> x.pos < size(terms))"))
    sentences = "flatten(transform(slice(p, 1, 4), q -> q.sentences))"
    out = out.withColumn("best_chunk", F.expr(f"coalesce(array_max(transform(p, q -> {coverage('q.terms')})), 0D)"))
    out = out.withColumn("best_sentence", F.expr(f"coalesce(array_max(transform({sentences}, s -> {coverage('s.terms')})), 0D)"))
    unseen = "size(filter(w, x -> x.df = 0))"
    off = f"(size(w) >= 2 and {unseen} / size(w) >= 0.34D) or exists(v, x -> array_contains(proper, x.term) and x.df = 0)"
    out = out.withColumn("cover", F.greatest("best_chunk", "best_sentence"))
    tier = f"case when size(terms) = 0 or {off} then 'none' when best_chunk >= 0.6 or best_sentence >= 0.5 then 'high' when cover >= 0.2 then 'low' else 'none' end"
    shown = f"exists({sentences}, s -> s.text rlike '\\\\p{{Nd}}' and s.text rlike '(?i)%|percent' and {coverage('s.terms')} >= 0.4D)"
    statistic = F.col("question").rlike(STATISTIC) & (F.size("terms") > 0)
    out = out.withColumn("tier", F.expr(tier)).withColumn("stat_ok", ~statistic | F.expr(shown)).withColumn("coverage", F.round("cover", 3))
    return out.drop("best_chunk", "best_sentence", "cover", "v")
