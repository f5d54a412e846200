"""What a reader sees: marked passages, page references, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import let, quoted


def marked(text: str, spans: str, left: str = "<mark>", right: str = "</mark>") -> str:
    """SQL of a text with its highlight spans marked; a span that begins before the end of the one before is left out."""
    step = f"if(x.start < a.at, a, named_struct('at', x.end, 'out', concat(a.out, substring({text}, a.at + 1, x.start - a.at), {quoted(left)}, substring({text}, x.start + 1, x.end - x.start), {quoted(right)})))"
    return f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))"


def with_pages(answer: str, sources: str) -> str:
    """SQL of an answer whose tags [Pn] are page references [p.n]; tags without a source show their own name."""
    pattern = quoted(r"\[P[0-9]+\]")
    name = "substring(t, 2, length(t) - 2)"
    found = let("h", f"filter({sources}, s -> s.id = {name})", f"if(size(h) > 0, concat('[p.', h[0].page, ']'), concat('[', {name}, ']'))")
    return f"array_join(zip_with(split({answer}, {pattern}, -1), transform(regexp_extract_all({answer}, {pattern}, 0), t -> {found}), (g, t) -> concat(g, coalesce(t, ''))), '')"


def bold_parts(answer: str) -> str:
    """SQL of the texts between double asterisks."""
    return f"regexp_extract_all({answer}, {quoted('[*][*](.+?)[*][*]')}, 1)"


def summary_pages(summary: str) -> str:
    """SQL of the pages that a summary refers to, in order."""
    return f"transform(regexp_extract_all({summary}, {quoted('[(]p[.]([0-9]+)[)]')}, 1), x -> cast(x as bigint))"


def short_name(name: str, length: int = 28) -> str:
    return f"left(regexp_replace({name}, {quoted('[.][^.]+$')}, ''), {length})"


def keyword_question(keyword: str) -> str:
    return f"concat('What does the document say about ', {keyword}, '?')"


def badges(sources: DataFrame) -> DataFrame:
    """Adds badge to rows with cited and weak."""
    return sources.withColumn("badge", F.when(F.col("weak"), "closest match").when(F.col("cited"), "cited").otherwise("related"))


def score_bars(sources: DataFrame, width: int = 90) -> DataFrame:
    """Adds bar: the score against the best of its question, 1 at least, in pixels."""
    best = F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(1.0))
    return sources.withColumn("bar", F.round(F.col("score") / best * width, 3))


def last_assistant(messages: DataFrame) -> DataFrame:
    """(scope, content) of the newest assistant message of each scope."""
    return messages.where("role = 'assistant'").groupBy("scope").agg(F.max_by("content", "id").alias("content"))
