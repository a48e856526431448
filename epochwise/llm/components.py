"""Connected components of a table of links, by repeated joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.storage import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node it can reach.

    Each round takes the smallest label among the neighbours, then the label of that
    label, so that paths halve. Labels are written in each round; no link and no
    label reaches the driver. Minima are taken before the shuffle, so that a node
    with very many links is no large group.
    """
    both = stage(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        closer = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        closer = stage(closer, "closer")
        jumped = (
            closer.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next")
            .select("node", F.least("next", "far").alias("next"), (F.least("next", "far") < F.col("label")).alias("moved"))
        )
        jumped = stage(jumped, "jumped")
        labels = jumped.select("node", F.col("next").alias("label"))
        if jumped.where("moved").isEmpty():
            return labels
