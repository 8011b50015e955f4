"""Connected components of links between 64-bit node ids, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrials.llm.common import stored


def _jumped(parents: DataFrame) -> DataFrame:
    """Follow parents (node, parent; a root is its own parent) to the roots by doubling."""
    while True:
        p, q = parents.alias("p"), parents.alias("q")
        step = stored(p.join(q, F.col("p.parent") == F.col("q.node"), "left").select(
            F.col("p.node").alias("node"), F.coalesce(F.col("q.parent"), F.col("p.parent")).alias("parent"),
            (F.coalesce(F.col("q.parent"), F.col("p.parent")) != F.col("p.parent")).alias("moved")), "jump")
        parents = step.select("node", "parent")
        if not step.where("moved").limit(1).count():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); label: the smallest node id reachable.

    Union-find as joins: each root takes the smallest root that a link leads to as its parent, paths
    are halved by doubling, links within one tree go; until no link is left.  The driver sees no
    link, only whether any are left.  Self-links and repeated links do no harm."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while links.limit(1).count():
        hooks = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = labels.where("node = label").join(hooks, "node", "left").select("node", F.coalesce("parent", "node").alias("parent"))
        roots = _jumped(roots)
        at = roots.select(F.col("node").alias("label"), F.col("parent").alias("root"))
        labels = stored(labels.join(at, "label").select("node", F.col("root").alias("label")), "labels")
        to = lambda side: roots.select(F.col("node").alias(side), F.col("parent").alias(f"{side}_root"))
        links = stored(links.join(to("a"), "a").join(to("b"), "b").select(
            F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).where("a <> b").distinct(), "links")
    return labels
