"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwave.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node of the links (long columns) can reach.

    Each round takes the smallest label among the neighbours (combined before the shuffle) and
    then the label of that label, so paths halve; stars need two rounds.  Every round starts from
    written tables, so nothing is computed again if an executor is lost.  No links, no rows.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node != other")
    edges = stored(both.distinct(), "edges")
    labels = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("seen"))
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = lower.join(jump, "next").select("node", F.col("label").alias("old"), F.least("next", "far").alias("label"))
        step = stored(moved, "labels")
        if step.where("label != old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")
