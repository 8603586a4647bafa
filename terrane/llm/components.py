"""Connected components of a distributed list of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b. Returns node, label for every node of a link; label is some node of its component.

    Each round hooks every node to its smallest neighbour or itself, replaces the links' ends by what they
    are hooked to and drops links within one node. A round at least halves the nodes that still have links,
    so there are few rounds; everything stays in Spark, staged after each."""
    links = common.stage(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = common.stage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while links.limit(1).count():
        both = links.select("a", "b").union(links.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        hook = common.stage(_jumped(hook))
        label = common.stage(label.join(hook.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        a, b = hook.select(F.col("node").alias("a"), F.col("to").alias("a2")), hook.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        links = common.stage(links.join(a, "a").join(b, "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    return label


def _jumped(hook: DataFrame) -> DataFrame:
    """Two hops at once: where a node's hook is hooked further, go there."""
    far = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
    return hook.join(far, "to").select("node", F.col("further").alias("to"))
