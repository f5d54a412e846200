"""Chat history: latest messages, the question before, turns for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(messages: DataFrame, limit: int = 100) -> DataFrame:
    """The latest messages of each scope; order by id to read them oldest first."""
    newest = Window.partitionBy("scope").orderBy(F.desc("id"))
    return messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit).drop("_r")


def previous_questions(messages: DataFrame, window: int = 8) -> DataFrame:
    """(scope, previous): the last user message among the latest `window` of each scope."""
    users = latest(messages, window).where("role = 'user'")
    return users.groupBy("scope").agg(F.max_by("content", "id").alias("previous"))


def turns(messages: DataFrame, limit: int = 6) -> DataFrame:
    """(scope, nr, role, content): the latest messages with neighbours of one role joined, from the first user turn, without
    a closing user turn."""
    rows = latest(messages, limit)
    order = Window.partitionBy("scope").orderBy("id")
    rows = rows.withColumn("new", F.coalesce((F.col("role") != F.lag("role").over(order)).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    runs = rows.groupBy("scope", "island", "role").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("c"))
    runs = runs.select("scope", "island", "role", F.expr("array_join(c.content, '\n')").alias("content"))
    whole = Window.partitionBy("scope")
    first = F.min(F.when(F.col("role") == "user", F.col("island"))).over(whole)
    runs = runs.withColumn("first", first).withColumn("last", F.max("island").over(whole)).where("island >= first and not (island = last and role = 'user')")
    nr = F.row_number().over(Window.partitionBy("scope").orderBy("island"))
    return runs.select("scope", nr.alias("nr"), "role", "content")


def without_scope(messages: DataFrame, scope: str) -> DataFrame:
    return messages.where(~F.col("scope").eqNullSafe(F.lit(scope)))
