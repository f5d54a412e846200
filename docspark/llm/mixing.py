"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The words of a source, its documents in a shuffled order that depends on ids only, form a stream that is cut into blocks
of equal numbers of words. Slot t of the mix takes the point frac(t * golden ratio), finds it among the sources' cumulative
targets, and the slots of a source, ranked by t, take its blocks in turn, beginning anew after the last. Places in the
stream come from two levels of running sums: over 4096 parts of the shuffled order, and within a part.

Blocks have a share 1 / SLOTS of the corpus, but at most 1 / GRAIN of their source, so that small sources come near their
targets too; a source with smaller blocks has a larger part of the points in turn.

Only built-in functions of DataFrames are used. The schedule has about SLOTS slots for any size of the corpus, and up to
6 * GRAIN more for each source with smaller blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.scratch import Scratch, row_keyed

#: Words are runs of other characters than blank and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 1 << 20
#: Blocks that a source has at least, if it has as many words.
GRAIN = 1 << 10
CYCLE = (5, 2, 1)
#: 2**32 / golden ratio: slot t has the point (t * GOLDEN mod 2**32) / 2**32.
GOLDEN = 2654435769
_CELL = 1 << 20


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, hash, carried columns) with the number of words; hash shuffles by the id, or by the text where it
    is missing."""
    size = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("text "), F.xxhash64(docs[text_col].cast("string")).cast("string")))
    return docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size"), F.md5(name.cast("binary")).alias("hash"), *(docs[c] for c in carry))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = 3, slots: int = SLOTS) -> DataFrame:
    """(nr, source, source_size, target, first, last, total, block, slots) per source: 100 % of all words shared by weight.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times the source's words, and the
    rest is shared by weight until none is above: sources are filled in the order of cap over weight, and the level is
    the first that leaves the next one below its cap. first and last are the source's part of [0, 2**32), in proportion to
    its target in blocks of `block` words; `slots` is the length of the schedule. One row per source meets in one task
    here, never a document.
    """
    weight = F.expr(f"element_at(array({', '.join(map(str, cycle))}), cast((nr - 1) % {len(cycle)} + 1 as int))")
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("nr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", weight.cast("long"))
    order, whole = Window.orderBy(F.expr(f"{most} * source_size / weight"), "nr"), Window.partitionBy()
    table = table.withColumn("total", F.sum("source_size").over(whole))
    table = table.withColumn("capped", F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    table = table.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    table = table.withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("open"))
    fits = F.when(F.expr(f"level <= {most} * source_size / weight"), F.col("level"))
    table = table.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    table = table.withColumn("target", F.least(F.expr(f"cast({most} * source_size as double)"), F.col("weight") * F.col("level")))
    table = table.withColumn("base", F.expr(f"greatest(1, total div {slots})")).withColumn("block", F.expr(f"greatest(1, least(base, source_size div {GRAIN}))"))
    more = F.ceil(F.sum(F.expr("target * (1 / block - 1 / base)")).over(whole))
    table = table.withColumn("slots", (F.expr("(total + base - 1) div base") + more).cast("long"))
    units = F.round(F.col("target") * 1000 * (F.col("base") / F.col("block"))).cast("long")
    upto = F.sum(units).over(Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, 0))
    edge = lambda x: F.floor(x / F.sum(units).over(whole).cast("double") * (1 << 32)).cast("long")
    some = F.col("total") > 0
    return table.select("nr", "source", "source_size", "target", F.when(some, edge((upto - units).cast("double"))).otherwise(0).alias("first"), F.when(some, edge(upto.cast("double"))).otherwise(0).alias("last"), "total", "block", "slots")


def block_schedule(targets: DataFrame, slots: int, *, most: int = 3) -> DataFrame:
    """(slot, nr, block, turn): the mix as a sequence of blocks, of the size that the source's row names."""
    spark = targets.sparkSession
    point = F.expr(f"(id * {GOLDEN}) % {1 << 32}")
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {_CELL}"))
    blocks = F.expr("(source_size + block - 1) div block").alias("blocks")
    parts = targets.where("last > first").select("nr", blocks, "first", "last", F.explode(F.expr(f"sequence(first div {_CELL}, (last - 1) div {_CELL})")).alias("cell"))
    taken = points.join(parts, "cell").where("first <= point and point < last")
    rank = (F.row_number().over(Window.partitionBy("nr").orderBy("slot")) - 1).cast("long")
    return taken.select("slot", "nr", rank.alias("rank"), "blocks").where(f"rank < {most} * blocks").select("slot", "nr", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("turn"))


def placed(sizes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, nr, source_size, target, size, place, carried columns) of rows (id, nr, hash, ...): place is where the document's
    words begin in the source's shuffled stream."""
    rows = sizes.withColumn("part", F.substring("hash", 1, 3))
    parts = rows.groupBy("nr", "part").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("nr").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("nr", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("nr", "part").orderBy("hash", "id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, ["nr", "part"]).withColumn("place", F.col("before") + F.col("inside")).drop("hash", "part", "before", "inside")


def mixed(docs: DataFrame, *, cycle: tuple[int, ...] = CYCLE, most: int = 3, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, carried columns) of every row: the words of it that the mix takes, repeats
    counted.

    Defined results: null and empty texts have size 0 and nothing is taken of them; a missing source is a source of its
    own, the last; rows that repeat an id are placed one after the other; without any word all targets are 0; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.table(sized(docs, id_col, text_col, source_col, carry), "sizes")
    targets = scratch.table(source_targets(sizes, cycle, most, slots), "targets")
    length = targets.agg(F.max("slots")).first()[0] or 0
    rows = sizes.join(targets.select("nr", "source_size", "target", F.col("block").alias("words_a_block"), F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of"))).select("id", "nr", "source_size", "target", "words_a_block", "size", "hash", *carry)
    rows = scratch.table(rows, "rows")
    times = block_schedule(targets, length, most=most).groupBy("nr", "block").agg(F.count("*").alias("times"))
    full = placed(rows.where("size > 0"), carry)
    parts = full.withColumn("block", F.explode(F.expr("sequence(place div words_a_block, (place + size - 1) div words_a_block)")))
    parts = parts.withColumn("words", F.expr("least((block + 1) * words_a_block, place + size) - greatest(block * words_a_block, place)"))
    taken = parts.join(times, ["nr", "block"], "left").groupBy("nr", "place", "id", "size", "source_size", "target", *carry).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = ["id", "size", "source_size", "target", "taken", *carry]
    out = taken.select(columns).unionAll(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))
    return out.withColumnRenamed("id", id_col)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` of which the mix takes words, all columns as they are, with size, target and taken (which stand in
    for columns of these names). Rows are told apart by their place in the files, so repeated ones have a decision each."""
    names = ["_file", "_place"]
    while set(names) & set(docs.columns):
        names = [f"_{name}" for name in names]
    keyed = row_keyed(docs, Scratch(docs.sparkSession), tuple(names))
    taken = mixed(keyed, carry=tuple(names), **how).where("taken > 0").select(*names, "size", "target", "taken")
    return keyed.drop("size", "target", "taken").join(taken, names).drop(*names)


#: The same rows in DuckDB's SQL, for the table documents.
SQL = f"""
with sizes as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source collate "C" nulls last) as nr from sizes group by source),
weighted as (select *, [5, 2, 1][((nr - 1) % 3 + 1)::int]::bigint as weight, (sum(source_size) over ())::bigint as total from sources),
levels as (select *, (total - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, nr rows between unbounded preceding and 1 preceding), 0))::double / (sum(weight) over (order by 3 * source_size / weight, nr rows between current row and unbounded following))::double as level from weighted),
leveled as (select *, (select arg_min(level, 3 * source_size / weight) from levels where level <= 3 * source_size / weight) as height from levels),
targeted as (select *, least((3 * source_size)::double, weight * height) as target, round(least((3 * source_size)::double, weight * height) * 1000)::bigint as units from leveled),
summed as (select *, (sum(units) over (order by nr))::bigint as upto, (sum(units) over ())::double as units_all from targeted),
edges as (select *, floor((upto - units)::double / units_all * 4294967296)::bigint as lo, floor(upto::double / units_all * 4294967296)::bigint as hi, greatest(1, total // {SLOTS}) as block from summed),
points as (select t.slot, (t.slot * {GOLDEN}) % 4294967296 as point from (select unnest(range((select ((max(total) + max(block) - 1) // max(block))::bigint from edges))) as slot) t),
ranked as (select nr, row_number() over (partition by nr order by slot) - 1 as rank, (source_size + block - 1) // block as blocks from points join edges on lo <= point and point < hi),
times as (select nr, (rank % blocks)::bigint as block, count(*) as times from ranked where rank < 3 * blocks group by all),
placed as (select doc_id, nr, size, source_size, target, block as b, coalesce(sum(size) over (partition by nr order by md5(doc_id::varchar), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as place from sizes join edges on sizes.source is not distinct from edges.source),
parts as (select *, unnest(case when size > 0 then range(place // b, (place + size - 1) // b + 1) else [place // b] end) as block from placed)
select doc_id, size, source_size, target, coalesce(sum(greatest(0, least((parts.block + 1) * b, place + size) - greatest(parts.block * b, place)) * coalesce(times, 0)), 0)::bigint as taken
from parts left join times using (nr, block) group by doc_id, nr, place, size, source_size, target
"""
