"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.workspace import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of undirected links ``a, b``: the smallest node reachable.

    Every round takes the smallest label of all neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of a chain's length.
    Labels are aggregated before they are shuffled, so a node with very many links is
    one row per task.  Each round is a written table, and ends when nothing changes.
    """
    both = stage(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")),
        "labels",
    )
    while True:
        seen = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(seen, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = stage(
            lower.join(jump, "component").select(
                "node", F.least("component", "next").alias("component"), "old"
            ),
            "labels",
        )
        labels = new.select("node", "component")
        if new.filter("component < old").isEmpty():
            return labels
