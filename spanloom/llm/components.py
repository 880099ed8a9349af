"""Connected components by contraction: every step hooks roots to smaller neighbours, halves the paths and drops the
edges that became loops. Edges and labels stay in tables of the shared folder; the driver only sees counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written


def components(links: DataFrame) -> DataFrame:
    """v and root, the smallest vertex of its component, for each vertex of the links (columns a and b)."""
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    vertices = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
    labels = written(vertices.select("v", F.col("v").alias("root")), "labels")
    while not edges.isEmpty():
        # a < b, so only b can hook to a smaller neighbour; the others stay roots
        hooks = written(edges.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("r"), "to"), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("r").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(up, "to", "left").select("r", F.coalesce("further", "to").alias("to"))
        hooks = written(hooks, "hooks")
        labels = written(labels.join(hooks, F.col("root") == F.col("r"), "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
        ends = edges.join(hooks.select(F.col("r").alias("a"), F.col("to").alias("x")), "a", "left").join(hooks.select(F.col("r").alias("b"), F.col("to").alias("y")), "b", "left")
        ends = ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b")
        edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
