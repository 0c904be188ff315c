"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): ``root`` is the smallest
    node reachable.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, so paths shrink by half or better; rounds are
    written to the shared folder and stop when no label changes.
    """
    both = (edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = written(both.groupBy("node").agg(F.min("other").alias("m"))
                     .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("other"), "root"), "other")
                .groupBy("node").agg(F.min("root").alias("m")))
        step = labels.join(seen, "node").select("node", "root", F.least("root", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        # another copy of the labels answers "the label of that label"
        new = written(step.join(jump, "next").select("node", "root", F.least("next", "far").alias("next")), "labels")
        if not new.where(F.col("root") != F.col("next")).limit(1).count():
            return new.select("node", F.col("next").alias("root"))
        labels = new.select("node", F.col("next").alias("root"))
