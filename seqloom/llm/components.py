"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize


def least_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node``, ``label`` of (``node``, ``label``) and (``a``, ``b``): the least label that links reach.

    A label is a struct whose field ``node`` names the node it comes from, so that a label's own
    label can be looked up: chains halve in each round. Every round is written, so the lineage stays
    short and lost executors cost no round twice.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "links")
    at = materialize(nodes.select("node", "label"), "labels")
    while True:
        near = both.join(at.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = at.join(near.withColumnRenamed("a", "node"), "node", "left")
        near = near.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        near = materialize(near, "near-labels")
        ahead = near.select(F.col("node").alias("of"), F.col("label").alias("ahead"))
        jumped = near.join(ahead, F.col("label.node") == F.col("of"), "left")
        jumped = jumped.select("node", F.least("label", "ahead").alias("label"), "old")
        at = materialize(jumped, "labels")
        if at.filter("label <> old").isEmpty():
            return at.select("node", "label")
