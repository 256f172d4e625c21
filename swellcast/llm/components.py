"""Connected components of a link table, as DataFrame rounds with stored tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellcast.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a long, b long); the label is the smallest node of its component.

    Each round a node takes the smallest label among itself and its neighbours and then its label's
    label. Labels only fall, so the rounds end; their number follows the logarithm of the diameter.
    """
    both = common.stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_n"))
                           .select("node", F.least("node", "_n").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near")))
        lower = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        new = common.stored(lower.join(jump, "label", "left").select(
            "node", "_old", F.least("label", F.coalesce("_far", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("label") < F.col("_old")).isEmpty():
            return labels
