"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, component), component being the smallest node reachable; nodes without edges are absent.

    Every round hooks each node to its smallest neighbour, halves the pointers once and contracts the edges, so the
    edge table shrinks with each round; only counts come to the driver, and no side of
    a join is broadcast, as Spark knows only the compressed size of the tables.  Null ends and loops are ignored.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    e = cut(e.union(e.select("b", "a")).distinct())
    labels = None
    while not e.isEmpty():
        hook = cut(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hook = cut(hook.join(far.hint("merge"), "to").select("node", F.col("far").alias("to")))
        if labels is None:
            labels = hook.select("node", F.col("to").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "to")
            labels = cut(labels.join(step.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        left, right = hook.select(F.col("node").alias("a"), F.col("to").alias("x")), hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = cut(e.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component"))
