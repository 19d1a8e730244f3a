"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moothall.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node it is connected to.

    Each round a node takes the smallest label among its neighbours', then the label of that
    label, so labels cross a chain in about log(length) rounds. Rounds are written tables. A node
    with very many links is combined before the shuffle; joins on labels are split by adaptive
    execution.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels.node == near.a).select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = durable(moved.join(target, "component", "left").select(
            "node", "before", F.coalesce("next", "component").alias("component")))
        labels = after.select("node", "component")
        if after.filter(F.col("component") != F.col("before")).isEmpty():
            return labels
