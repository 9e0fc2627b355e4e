"""Connected components of an edge table by label propagation with pointer jumping, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node each node is connected to. ``edges`` has a and b of an ordered type.

    Each round takes the smallest label among the neighbours, then the label of the label, and writes the result;
    it ends when no label changes, after about the logarithm of the longest path. Minima combine map-side, and the
    written tables on both sides of each join let adaptive execution split a hot node.
    """
    both = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "n", "comp": "c"}), F.col("b") == F.col("n"))
        offers = near.select(F.col("a").alias("node"), F.col("c").alias("comp")).unionAll(labels.select("node", "comp"))
        lower = materialize(offers.groupBy("node").agg(F.min("comp").alias("comp")))
        up = lower.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        jumped = lower.join(up, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("c", "comp").alias("comp"))
        old = labels.withColumnsRenamed({"node": "n", "comp": "c"})
        marked = materialize(jumped.join(old, F.col("node") == F.col("n")).select("node", "comp", (F.col("comp") != F.col("c")).alias("new")))
        discard(labels, lower)
        labels = marked.select("node", "comp")
        if not marked.where("new").head(1):
            discard(both)
            return labels
