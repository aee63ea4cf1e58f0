"""Connected components of links between ids, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairforge.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every id in links (a, b); a component is named after its smallest id.

    Each round hooks every tree of labels to the smallest label next to it and then halves the trees' height, so the
    number of rounds grows with the logarithm of the longest chain. Labels and links stay in tables.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        # the smallest label among a node's neighbours, offered to the node and to the node that its label names
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        offered = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("best"))
        hooks = offered.select("node", "best").unionByName(offered.select(F.col("component").alias("node"), "best")).groupBy("node").agg(F.min("best").alias("best"))
        hooked = written(labels.join(hooks, "node", "left").select("node", F.col("component").alias("was"), F.coalesce(F.least("component", "best"), "component").alias("component")))
        parent = hooked.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = written(hooked.join(parent, "component", "left").select("node", "was", F.coalesce("above", "component").alias("component")))
        done = jumped.where("was <> component").isEmpty()
        discard(hooked, labels)
        labels = jumped
        if done:
            discard(both)
            return labels.select("node", "component")
