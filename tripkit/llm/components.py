"""Connected components of a large graph, by hooking and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripkit.operators.layout import checkpointed


def _to_roots(parents: DataFrame) -> DataFrame:
    """Replace each node's parent by its root, halving the remaining depth in each turn."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = checkpointed(
            parents.join(above, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                F.col("grand").isNotNull().alias("moved"),
            )
        )
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node that is not the smallest of its component.

    The component is named by its smallest node, which has no row itself, nor have nodes
    without edges. Loops, repeated edges, either direction and NULL ends are fine (an edge
    with a NULL end links nothing); no edges give no rows.

    Every turn hooks each node to its smallest smaller neighbour, follows the hooks to their
    roots and contracts the edges, so at most half of the nodes that still have edges remain.
    All steps are joins with a table of one row per node, whose larger side Spark can split
    at a hot node, and aggregates that combine before they shuffle. Each turn is checkpointed.
    """
    a, b = F.col(f"`{src}`").cast("long"), F.col(f"`{dst}`").cast("long")
    left = checkpointed(
        edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    labels = None
    while not left.isEmpty():
        roots = _to_roots(
            checkpointed(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        )
        high = roots.select(F.col("node").alias("hi"), F.col("parent").alias("hi_root"))
        low = roots.select(F.col("node").alias("lo"), F.col("parent").alias("lo_root"))
        x, y = F.col("hi_root"), F.coalesce("lo_root", "lo")
        left = checkpointed(
            left.join(high, "hi")
            .join(low, "lo", "left")
            .where(x != y)
            .select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
            .distinct()
        )
        if labels is None:
            labels = roots
        else:
            above = roots.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            labels = checkpointed(
                labels.join(above, "parent", "left")
                .select("node", F.coalesce("grand", "parent").alias("parent"))
                .unionByName(roots)
            )
    if labels is None:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))
