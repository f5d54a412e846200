"""Connected components of a link table, by union-find in partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.scratch import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: (node, root) for every node that isn't its own root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: larger (or not larger) neighbours of each node are linked with the smallest of all of them."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select("a", "b")
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
    met = both.join(least, both["a"] == least["n"])
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, root) of every node of links (a, b) of bigints; root is the smallest node of its component.

    Each round is two aggregations and joins on nodes; rounds grow with the logarithm of the number of nodes. A hub
    needs no task of its own: minima are aggregated before the shuffle and its join partition can be split. Links may
    repeat and hold loops; no links give no rows.
    """
    now = scratch.table(links.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), f"{name}-0")
    step = 0
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = now.select(mark.alias("x")).first()["x"]
    while seen["n"]:
        step += 1
        # every link goes from a larger node to a smaller one
        after = scratch.table(_star(_star(now, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now, old = after, seen
        seen = now.select(mark.alias("x")).first()["x"]
        if seen == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
