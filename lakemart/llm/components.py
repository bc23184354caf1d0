"""Connected components of a graph that is given as edges of random 64-bit keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (equal in a component) of edges ``a``, ``b`` (longs, hashes so that order is random).

    Each round every node joins its smallest neighbour and the graph is contracted to the
    roots; with random keys a round keeps a fraction of the nodes, so rounds grow with the
    logarithm of the largest component. Nodes, labels and edges stay distributed; the
    driver only learns whether edges are left. Without edges the result is empty.
    """
    current = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        if current.isEmpty():
            return labels if labels is not None else current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = current.union(current.select("b", "a"))
        smallest = both.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("near"))
        step = stored(smallest.select("old", F.least("old", "near").alias("new")), "step")
        if labels is None:
            labels = step.select(F.col("old").alias("node"), F.col("new").alias("root"))
        else:
            moved = labels.join(step, F.col("root") == F.col("old"), "left")
            labels = stored(moved.select("node", F.coalesce("new", "root").alias("root")), "labels")
        left = current.join(step.select(F.col("old").alias("a"), F.col("new").alias("x")), "a")
        left = left.join(step.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
        current = stored(
            left.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
