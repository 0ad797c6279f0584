"""Connected components of a graph of any size, by contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b) that has a neighbour: root is the component's smallest node.

    Each round every node points to its smallest neighbour (pre-aggregated before the shuffle) and then to where that
    one points; edges between equal ends go, equal edges become one. A star of any size is gone after one round, a chain
    of n nodes after some log n."""
    left = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = cut(left.select(F.col("a").alias("node")).unionAll(left.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")), "labels")
    while not left.isEmpty():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("y")), "pointers")
        on = to.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
        to = cut(to.join(on, F.col("y") == F.col("_x")).select("x", F.col("_y").alias("y")), "pointers")
        new = left.join(to, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        new = new.join(to, F.col("b") == F.col("x")).select("a", F.col("y").alias("b")).filter("a <> b")
        old = left
        left = cut(new.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        moved = labels.join(to, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root"))
        before, labels = labels, cut(moved, "labels")
        discard(old, before)
    return labels
