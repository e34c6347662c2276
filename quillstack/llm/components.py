"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import cut, forget, joined, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, upper: bool) -> DataFrame:
    """One star step. upper: all neighbours above a node go to its least neighbour; else those below do.

    A node's least neighbour is found by partial aggregates and told to its edges without gathering them.
    """
    if upper:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "star")
        moved = joined(around.where("b > a"), least, ["a"], "n").select(F.col("m").alias("a"), "b")
    else:
        around = edges.select(F.col("b").alias("x"), F.col("a").alias("v"))
        least = cut(around.groupBy("x").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star")
        below = joined(around, least, ["x"], "n").select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = below.unionAll(least.select(F.col("m").alias("a"), F.col("x").alias("b")))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of `edges` (a, b, longs) the least node of its component, written.

    Large and small stars in turn, each written to the shared folder, until a pair of them changes
    nothing. Nodes without edges have no row. Nothing but counts reaches the driver.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        after, next_path = written(_star(_star(now, True), False), "edges")
        forget(spark, path)
        now, path, before = after, next_path, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
