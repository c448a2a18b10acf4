"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the component is its smallest node.

    In each round nodes are ordered by a hash of their own and the round's, every node
    points to the first of itself and its neighbours, and the edges are rewritten to
    these; edges within a node go. As the order changes, the nodes that are left fall by
    a constant factor in expectation, on long chains too, so the rounds are few. The
    rounds' pointers, written tables, are then followed to the end; nothing but the
    question whether edges are left comes to the driver.
    """
    left = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    levels = []
    while not left.isEmpty():
        place = lambda c, k=len(levels): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        near = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min(place("b")).alias("m"))
        step = materialize(near.select(F.col("a").alias("node"), F.least(place("a"), F.col("m"))["n"].alias("to")), "pointers")
        levels.append(step)
        at_a = left.join(step.withColumnRenamed("to", "x"), F.col("a") == F.col("node")).select("b", "x")
        both = at_a.join(step.withColumnRenamed("to", "y"), F.col("b") == F.col("node")).where("x <> y")
        left = materialize(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[0].select("node", F.col("to").alias("root"))
    for level in levels[1:]:
        out = out.join(level.select(F.col("node").alias("_n"), "to"), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("to", "root").alias("root"))
    out = materialize(out, "roots")
    least = materialize(out.groupBy("root").agg(F.min("node").alias("component")), "least")
    return out.join(least, "root").select("node", "component")
