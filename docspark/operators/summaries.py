"""Keywords and extractive summaries of documents from their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.words import KEYWORD_STOP, META_WORDS, NO_SUMMARY, STOPWORDS

VERB = r"\b(is|are|refers to|was|were)\b"
_BARRED = T.words_in(dict.fromkeys(map(T.stemmed, KEYWORD_STOP)))


def term_stats(pages: DataFrame) -> DataFrame:
    """(doc_id, stem, tf, pages, form): counts of the content words, and their commonest form, the first seen if tied."""
    tokens = f"transform({T.raw_tokens('text')}, (t, i) -> named_struct('raw', t, 'low', lower(t), 'pos', i))"
    content = f"x.low not in {T.words_in(dict.fromkeys(STOPWORDS + META_WORDS))} and length(x.low) >= 3 and not x.low rlike '^\\\\p{{Nd}}+$'"
    shown = "if(length(x.raw) > 1 and x.raw rlike '^[^a-z]*[A-Z][^a-z]*$', x.raw, x.low)"
    words = f"transform(filter({tokens}, x -> {content}), x -> named_struct('stem', {T.stem('x.low')}, 'form', {shown}, 'pos', x.pos))"
    words = pages.select("doc_id", "page", F.inline(F.expr(words)))
    forms = words.groupBy("doc_id", "stem", "form", "page").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    forms = forms.groupBy("doc_id", "stem", "form").agg(F.sum("n").alias("n"), F.min(F.struct("page", "pos")).alias("at"), F.collect_list("page").alias("pages"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "at", "form"))
    stats = forms.groupBy("doc_id", "stem").agg(F.sum("n").alias("tf"), F.flatten(F.collect_list("pages")).alias("pages"), best.alias("best"))
    return stats.select("doc_id", "stem", "tf", F.size(F.array_distinct("pages")).cast("long").alias("pages"), F.col("best.form").alias("form"))


def weight():
    return F.expr("tf * ln(1 + pages)")


def keywords(stats: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, rank, keyword): the forms of up to n stems by tf * ln(1 + pages), with tf of 3 at least."""
    ordered = Window.partitionBy("doc_id").orderBy(F.desc(F.round(weight(), 9)), "stem")
    out = stats.where(f"tf >= 3 and stem not in {_BARRED}").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= n)
    return out.select("doc_id", "rank", F.col("form").alias("keyword"))


def good_sentence(s: str) -> str:
    """SQL of the conditions for a summary sentence."""
    return f"""length({s}) between 45 and 380 and {s} rlike '^\\\\p{{Lu}}' and {T.letter_share(s)} >= 0.75
        and not {s} rlike {T.quoted(r'(?iU)https?://|://|[(]htt|\bISBN\b|\bdoi\b|\bRetrieved\b|\bArchived\b')}
        and not {s} rlike {T.quoted(r'(?iU)^(See also|External links|References|Further reading)\b')}
        and size(filter(slice(split({s}, ' '), 2, 400), x -> x rlike '^\\\\p{{Lu}}')) / greatest(1, size(split({s}, ' ')) - 1) <= 0.3
        and {s} rlike '[.!?]$'"""


def without_caption(s: str) -> str:
    """SQL of a sentence cut to its last capitalised word that leaves four words before the defining verb."""
    verb = f"regexp_instr({s}, {T.quoted('(?U)' + VERB)})"
    words = f"split(regexp_replace(substring({s}, 1, {verb} - 1), ' +$', ''), ' ')"
    starts = "transform(ws, (x, i) -> named_struct('i', i, 'x', x, 'at', length(array_join(slice(ws, 1, i), ' ')) + if(i > 0, 1, 0)))"
    best = T.let("ws", words, f"coalesce(array_max(transform(filter({starts}, q -> q.i > 0 and q.x rlike '^[A-Z][a-z]+$' and size(ws) - q.i >= 4), q -> q.at)), 0)")
    return f"if(length({s}) < 120 or {verb} = 0, {s}, substring({s}, {best} + 1))"


def summaries(pages: DataFrame, stats: DataFrame, body: int = 4) -> DataFrame:
    """(doc_id, summary) of every document with pages: a defining sentence of the first two pages and up to `body` others,
    from different pages first, in their order, as bullets with the page."""
    sents = pages.select("doc_id", "page", F.posexplode(F.expr(T.sentences("text"))).alias("j", "s")).where(F.expr(good_sentence("s")))
    sents = sents.withColumn("defines", F.expr(f"page <= 2 and left(s, 160) rlike {T.quoted('(?U)' + VERB)}")).withColumn("cut", F.expr(f"if(defines, {without_caption('s')}, s)"))
    sents = sents.withColumn("both", F.expr("array_distinct(array(s, cut))")).select("*", F.posexplode("both").alias("which", "v"))
    words = sents.withColumn("ts", F.expr(T.terms("v"))).withColumn("len", F.size("ts"))
    each = words.select("doc_id", "page", "j", "which", "len", F.explode(F.expr("array_distinct(ts)")).alias("stem")).join(stats.select("doc_id", "stem", weight().alias("w")), ["doc_id", "stem"])
    scores = each.groupBy("doc_id", "page", "j", "which").agg(F.expr("aggregate(array_sort(collect_list(w)), 0D, (a, x) -> a + x) / sqrt(first(len))").alias("score"))
    full = sents.join(scores, ["doc_id", "page", "j", "which"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    # which 0 is the sentence itself; the cut one, if it differs, is which 1
    full = full.groupBy("doc_id", "page", "j", "s", "cut", "defines").agg(F.max(F.when(F.col("which") == 0, F.col("score"))).alias("score"), F.max_by("score", "which").alias("cut_score"))
    packed = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "j", "s", "cut", "defines", "score", "cut_score"))).alias("c"))
    lead = "array_sort(transform(filter(c, x -> x.defines), x -> named_struct('o', -x.cut_score, 'page', x.page, 'j', x.j, 's', x.cut)))"
    packed = packed.withColumn("lead", F.expr(f"slice({lead}, 1, 1)"))
    others = "array_sort(transform(filter(c, x -> size(lead) = 0 or not (contains(lead[0].s, x.s) or contains(x.s, lead[0].s))), x -> named_struct('o', -x.score, 'page', x.page, 'j', x.j, 's', x.s)))"
    skip = "exists(a, y -> y.page = x.page) and size(array_distinct(transform(a, y -> y.page))) < 4"
    chosen = f"aggregate({others}, lead, (a, x) -> if(size(a) >= size(lead) + {body} or ({skip}), a, concat(a, array(x))))"
    lines = f"array_join(transform(array_sort(transform({chosen}, x -> named_struct('page', x.page, 'j', x.j, 's', x.s))), x -> concat('• ', x.s, ' (p.', x.page, ')')), '\n')"
    packed = packed.select("doc_id", F.expr(lines).alias("summary"))
    return pages.select("doc_id").distinct().join(packed, "doc_id", "left").select("doc_id", F.coalesce("summary", F.lit(NO_SUMMARY)).alias("summary"))


def summary_prompts(pages: DataFrame, budget: int = 14_000) -> DataFrame:
    """(doc_id, body) for a model: the first three pages up to half the budget, then an even share of each other page."""
    packed = pages.groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(page, text))), x -> x.text)").alias("t"))
    packed = packed.withColumn("head", F.expr(f"left(array_join(slice(t, 1, 3), '\n'), {budget // 2})"))
    packed = packed.withColumn("per", F.expr(f"greatest(300, cast(({budget} - length(head)) div greatest(1, size(t) - 3) as int))"))
    rest = f"left(array_join(transform(slice(t, 4, greatest(0, size(t) - 3)), (x, i) -> concat('[page ', i + 4, '] ', left(x, per))), '\n'), {budget} - length(head))"
    return packed.select("doc_id", F.expr(f"concat('[pages 1-3] ', head, '\n', {rest})").alias("body"))
