"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.store import kept


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that edges (a, b) reach; loops and repeats are fine.

    Each round a node takes the smallest label around it, then its label's label, so chains
    halve. Every round is a written table; the driver sees one count a round. A hot node
    has one row a neighbour, aggregated where the rows are before they are sent.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = state.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the label's own label: from its row, and handed to it by those that found a smaller one
        told = met.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("told"))
        met = kept(met.join(told, "node", "left").select("node", "old", F.least("label", "told").alias("label")), "labels")
        up = met.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = kept(met.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels")
        changed = after.where("old <> label").limit(1).count()
        state = after.select("node", "label")
        if not changed:
            return state
