"""Connected components of an edge table, by the smallest id reachable.

Labels and edges stay in tables: each round takes the smallest label among a node and its neighbours, then
the label's own label, and writes the result to the shared folder. The driver reads one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearword.llm.storage import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of each node in ``edges`` (a, b): the smallest node of its component."""
    both = scratch.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = scratch.cut(better.join(up, "label", "left").select("node", "was", F.coalesce("further", "label").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label != was").isEmpty():
            return labels
