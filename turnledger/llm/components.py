"""Connected components by hooking and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def starred(parent: DataFrame) -> DataFrame:
    """(node, up) with up taken to the root of each tree; paths halve with each pass over the nodes."""
    while True:
        above = parent.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        jumped = written(parent.join(above, F.col("up") == F.col("mid")).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "cc-parents")
        parent = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of ``edges`` (a, b): label is the smallest node of its component.

    In each round every node hooks onto its smallest neighbour, trees are
    flattened, and the edges are drawn anew between the roots; those within a
    tree vanish, so each round has at most half the nodes and only what is left
    of the edges. At the end labels are taken down through the rounds. Rounds
    are written to the shared folder, so lineage stays short; the driver sees
    whether a table is empty. Minima are combined before the shuffle, so a node
    of any degree is one row a task there, and a node that many edges end in is
    a skewed join, which Spark splits. No edges give no rows.
    """
    drawn = lambda df: written(df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    edges, levels = drawn(edges), []
    while not edges.isEmpty():
        ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
        # the smaller end of an edge is a candidate for both ends, and each node one for itself
        parent = written(ends.groupBy("node").agg(F.min("a").alias("up")), "cc-parents")
        parent = starred(parent)
        levels.append(parent)
        up_a, up_b = (parent.select(F.col("node").alias(f"{x}_node"), F.col("up").alias(f"{x}_up")) for x in "ab")
        moved = edges.join(up_a, F.col("a") == F.col("a_node")).join(up_b, F.col("b") == F.col("b_node"))
        edges = drawn(moved.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")))
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = levels[-1].withColumnRenamed("up", "label")
    for level in reversed(levels[:-1]):
        above = label.select(F.col("node").alias("root"), "label")
        label = level.join(above, F.col("up") == F.col("root"), "left").select("node", F.coalesce("label", "up").alias("label"))
    return written(label, "cc-labels")
