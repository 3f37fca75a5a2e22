"""Connected components by repeated contraction, without gathering the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _resolve(parent: DataFrame) -> DataFrame:
    """Follow ``node -> up`` to the end of its chain, doubling the step each time."""
    while True:
        far = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = saved(
            parent.join(far, "up", "left")
            .select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved"))
        )
        if parent.where("moved").isEmpty():
            return parent.select("node", "up")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) over comparable nodes -> (node, root), the root being the smallest node of the component.

    Every round hooks each node to its smallest neighbour, resolves the chains, and maps the edges to the roots. The
    number of nodes with an edge at least halves, so the rounds grow with the logarithm of the longest path. Hot nodes
    are met only by partial aggregation and by joins on a unique side, which adaptive execution splits.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        ways = edges.union(edges.select("b", "a"))
        up = _resolve(saved(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                            .select("node", F.least("node", "low").alias("up"))))
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = labels.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = saved(labels)
        to_a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        to_b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = saved(
            edges.join(to_a, "a").join(to_b, "b").where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
