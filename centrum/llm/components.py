"""Connected components of an edge table by contraction: every round at least halves the nodes that still have edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from centrum.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node it is linked with) for every node of ``edges(a, b)``.

    Nodes point to their smallest neighbour, pointers are doubled until they reach roots, and roots are linked by what is
    left of the edges. A node with very many edges costs one partial minimum a task. Self-loops and repeated edges are allowed.
    """
    edges = stored(edges.select(F.col("a"), F.col("b")), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        lowest = both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label"))
        roots = _roots(stored(lowest, "pointers"))
        a = roots.select(F.col("node").alias("a"), F.col("label").alias("root_a"))
        b = roots.select(F.col("node").alias("b"), F.col("label").alias("root_b"))
        pairs = edges.join(a, "a").join(b, "b").where("root_a <> root_b")
        edges = stored(pairs.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def _roots(pointers: DataFrame) -> DataFrame:
    """Every node with the end of its chain of pointers; chains only go down."""
    while True:
        ends = pointers.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = pointers.join(ends, "label", "left")
        if moved.where("to is not null").isEmpty():
            return pointers
        pointers = stored(moved.select("node", F.coalesce("to", "label").alias("label")), "pointers")
