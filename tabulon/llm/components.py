"""Connected components of a link table, by hooking to the smallest neighbour, jumping and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node of a link its component's smallest node.

    Each round hooks every node to its smallest neighbour if that is smaller, jumps along these hooks until they end in
    roots, and contracts links to roots, which at least halves the nodes that still have links. The smallest
    node of a component always stays a root, so labels are exact. Hubs are no trouble: minima are combined before the shuffle.
    Rounds are checkpointed. Self links and repeated links are allowed; null ends are not.
    """
    links = settle(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct())
    labels: DataFrame | None = None
    while True:
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("node", "near")
        hooks = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
        hooks = settle(hooks)
        while True:
            ends = hooks.toDF("label", "further").where("label != further")
            jumped = settle(hooks.join(ends, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")))
            hooks = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            labels = settle(labels.join(hooks.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        left = links.join(hooks.toDF("a", "x"), "a").join(hooks.toDF("b", "y"), "b").where("x != y")
        links = settle(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if links.isEmpty():
            return labels


def joined(labels: DataFrame, more: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`labels` of `components` after further links (a, b): as if all links had been given at once.

    Only the further links are worked on, each as a link between the labels of its ends. Ends without a label come as nodes
    of their own. A label is its component's smallest node, so the smallest label is the smallest node here too.
    """
    more = more.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    ends = more.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    roots = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    new = more.select("a").union(more.select("b")).distinct().toDF("node").join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return settle(labels.union(new).join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
