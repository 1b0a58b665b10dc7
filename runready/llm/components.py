"""Connected components of an edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runready.llm.tables import stored

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node reachable) for every node of ``edges(a, b)``.

    Each round hooks a node to its least neighbour, if that is smaller, jumps from label to label until all nodes know the
    top of their tree, and goes on with the edges between different tops alone: an edge inside a tree is not looked at
    again, however many rounds follow.  Labels and edges are written to the shared folder; none reaches the driver, only the
    count of what is left.  A node with a third of all edges is the unsplit key of no aggregate: minima are pre-aggregated,
    and the joins are plain equi-joins against one row per node, whose many-rowed side AQE splits.
    """
    def apart(pairs: DataFrame) -> DataFrame:
        return stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    left, labels = apart(edges), None
    for _ in range(MAX_ROUNDS):
        tops = _tops(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
        if labels is None:
            labels = tops
        else:
            onto = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = labels.join(onto, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
            labels = stored(labels.unionByName(tops), "labels")
        left = apart(left.join(tops.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
                     .join(tops.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
                     .select(F.col("la").alias("a"), F.coalesce("lb", "b").alias("b")))
        if not left.limit(1).count():
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _tops(labels: DataFrame) -> DataFrame:
    """``labels(node, label)``, each label smaller than its node, with the label at the end of its chain."""
    labels = stored(labels, "labels")
    for _ in range(MAX_ROUNDS):
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stored(labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"),
                                                                     F.col("further").isNotNull().alias("moved")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"labels did not settle in {MAX_ROUNDS} rounds")


__all__ = ["connected_components"]
