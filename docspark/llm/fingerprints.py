"""Document fingerprints by I-Match with randomised lexicons.

Terms are distinct words with A-Z lower-cased. The lexicon keeps the terms in `low` to `high` of all documents, which is
a band of inverse document frequency; as a document has D terms on average, at most D / low terms can be in it, whatever
the corpus. A fingerprint has one hash per sub-lexicon: of a document's sorted distinct terms within it. Sub-lexicons are
the whole lexicon and random parts of 1/8, 1/32 and 1/128 of it, PARTS of each, chosen by bits of a term's hash. The
likeness of two fingerprints is the share of equal hashes among the sub-lexicons in which at least one of them has terms.

Only built-in functions of DataFrames are used. The next document in the order of ids is found within ranges of ids of
about equal numbers of rows; only the first row of each range is looked up across ranges.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.scratch import Scratch, integer_id

WORD = r"[^\\x20\\x09-\\x0D]+"
PARTS = 8
LAST = (1 << 63) - 1
#: Rows of a range of ids, about, and the number of ranges at most.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 16
#: Terms that a plan holds at most; a larger lexicon is refused with advice (it can't be with `low` 0.001 and fewer than 500
#: distinct words a document on average).
MOST_TERMS = 500_000
#: Characters of a plan's description at most.
PLAN_CHARS = 1 << 16


def _terms(text: str) -> str:
    """SQL of the distinct hashed words of an SQL text."""
    return f"array_distinct(transform(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}', 0), x -> xxhash64(x)))"


def lexicon(texts: DataFrame, low: float, high: float) -> list[int]:
    """Hashes of the terms whose share of documents is within the band."""
    rows = texts.count()
    counts = texts.select(F.explode(F.expr(_terms("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    kept = counts.where((F.col("n") >= max(1.0, low * rows)) & (F.col("n") <= max(1.0, high * rows))).select("t")
    found = kept.limit(MOST_TERMS + 1).toArrow().column("t").to_pylist()
    if len(found) > MOST_TERMS:
        raise ValueError("the lexicon is too large: raise `low`")
    return sorted(found)


def bucketed(terms: list[int]) -> str:
    """SQL of the terms as an array of arrays by their last bits; a constant, which the optimizer evaluates once."""
    buckets: list[list[int]] = [[] for _ in range(1 << max(0, len(terms) - 1).bit_length())]
    for term in terms:
        buckets[term % len(buckets)].append(term)
    return f"from_json('{str(buckets).replace(' ', '')}', 'array<array<bigint>>')"


def fingerprint(text: str, terms: list[int]) -> str:
    """SQL of the fingerprint, an array of hashes (null for a sub-lexicon without terms of the text), of an SQL text.

    A text without a term of the lexicon is taken with all of its terms.
    """
    last = (1 << max(0, len(terms) - 1).bit_length()) - 1
    inside = f"filter(a, x -> array_contains(get({bucketed(terms)}, cast(x & {last}L as int)), x))"
    sorted_terms = f"element_at(transform(array({_terms(text)}), a -> element_at(transform(array({inside}), k -> array_sort(if(size(k) > 0, k, a))), 1)), 1)"
    hashed = lambda terms: f"if(size({terms}) > 0, xxhash64(array_join(transform({terms}, x -> string(x)), ',')), null)"
    parts = [hashed("k")]
    for level, bits in enumerate((3, 5, 7)):
        for part in range(PARTS):
            # bits of the term's hash anew for each sub-lexicon
            own = f"filter(k, x -> (xxhash64(x, {level * PARTS + part}) & {(1 << bits) - 1}) = 0)"
            parts.append(f"element_at(transform(array({own}), m -> {hashed('m')}), 1)")
    return f"element_at(transform(array({sorted_terms}), k -> array({', '.join(parts)})), 1)"


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes of two fingerprint columns; 1 if neither has any."""
    pairs = f"filter(zip_with({a}, {b}, (x, y) -> case when x is null and y is null then null else x <=> y end), e -> e is not null)"
    return F.expr(f"element_at(transform(array({pairs}), e -> if(size(e) = 0, 1.0D, size(filter(e, v -> v)) / cast(size(e) as double))), 1)")


def ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds key (the id, a missing one last), tie (a hash of the text) and range, whose numbers ascend with key and tie.

    Ranges of ids have about equal numbers of rows; an id that fills several has as many ranges of ties of its own.
    """
    rows = rows.withColumn("key", F.coalesce("id", F.lit(LAST))).withColumn("tie", F.xxhash64("text"))
    found = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] if ranges > 1 else None
    counts = Counter(found or ())
    if not counts:
        return rows.withColumn("range", F.lit(0).cast("long"))
    # how many edges are at or below the key, by bisection
    number = lambda values: f"from_json('{str(list(values)).replace(' ', '')}', 'array<bigint>')"
    edges, many, middle = number(sorted(counts)), number(counts[e] for e in sorted(counts)), "(s[0] + s[1]) div 2"
    below = f"aggregate(sequence(1, {len(counts).bit_length() + 1}), array(0L, {len(counts)}L), (s, k) -> if(s[0] < s[1], if(get({edges}, cast({middle} as int)) <= key, array({middle} + 1, s[1]), array(s[0], {middle})), s), s -> s[0])"
    rows = rows.withColumn("below", F.expr(below)).withColumn("m", F.expr(f"get({many}, cast(below - 1 as int))"))
    part = f"case when below = 0 or m = 1 then 0L when key > get({edges}, cast(below - 1 as int)) then m else least(m - 1, cast(floor((tie / 18446744073709551616D + 0.5D) * m) as bigint)) end"
    return rows.withColumn("range", F.expr(f"below * {2 * MOST_RANGES}L + ({part})")).drop("below", "m")


def fingerprints(docs: DataFrame, *, low: float = 0.001, high: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last floor(n_chars / 2) characters replaced by as many first ones (or all) of the
    next document by ascending id, after the last by those of the first; fingerprints are texts of hexadecimal hashes, `-`
    for a sub-lexicon without terms. Defined results: null is an empty text; rows that repeat an id follow each other by
    a hash of the text; rows without an id come last; a single row is its own next; no rows give no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(integer_id(docs, id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    terms = lexicon(rows.select("text"), low, high)
    # the lexicon is part of the plan, and each description of the plan, of which the driver keeps many, would spell it out
    if spark._jsparkSession.sessionState().conf().maxPlanStringLength() > PLAN_CHARS:
        spark.conf.set("spark.sql.maxPlanStringLength", PLAN_CHARS)
    placed = ranged(rows, min(MOST_RANGES, max(1, total // RANGE_ROWS)))
    hashed = placed.withColumn("fp", F.expr(fingerprint("text", terms)))
    # the first row of each range is the next of the last row of the range before; there are MOST_RANGES ranges or so
    order = Window.orderBy("range")
    follows = placed.groupBy("range").agg(F.min("key").alias("key")).withColumn("before", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())))
    follows = scratch.table(follows, "follows")
    heads = placed.join(F.broadcast(follows), ["range", "key"])
    heads = heads.withColumn("nr", F.row_number().over(Window.partitionBy("range").orderBy("tie"))).where("nr = 1")
    heads = heads.select(F.col("before").alias("range"), F.col("text").alias("head_text"), F.expr(fingerprint("text", terms)).alias("head_fp"))
    heads = scratch.table(heads, "heads")
    own = Window.partitionBy("range").orderBy("key", "tie")
    full = hashed.withColumn("next_text", F.lead("text").over(own)).withColumn("next_fp", F.lead("fp").over(own)).join(heads, "range")
    full = full.withColumn("next_fp", F.when(F.col("next_text").isNull(), F.col("head_fp")).otherwise(F.col("next_fp"))).withColumn("next_text", F.coalesce("next_text", "head_text"))
    n = F.length("text").cast("long")
    half = F.expr("cast(length(text) div 2 as int)")
    full = full.select("id", "fp", "next_fp", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    full = full.withColumn("edited_fp", F.expr(fingerprint("edited", terms)))
    shown = lambda c: F.expr(f"array_join(transform({c}, x -> coalesce(lower(hex(x)), '-')), ' ')")
    return full.select(F.col("id").cast(kind).alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
