"""Connected components by least labels with pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node that can be reached) of every node of ``links`` (a, b).

    Each round takes the least label around a node, then the label of that label, so
    chains shorten by half at least.  Every round is a table; nothing comes to the driver
    but the fact that something changed.
    """
    both = links.where("a <> b").select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("component")))
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        )
        least = labels.join(around, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        onward = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        moved = cut_lineage(
            least.join(onward, "now").select("node", "was", F.least("now", "next").alias("component")))
        labels = moved.select("node", "component")
        if not moved.where("component <> was").limit(1).count():
            return labels
