"""Connected components of a link table, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links(a, b), whose ends are of one type that sorts.

    Each round links every node to the smallest node it can see and then
    follows one more step, until nothing changes; rounds grow with the
    logarithm of the longest path.  Tables are written between rounds, and
    both sides of each join come from tables, so that adaptive execution can
    split a node with very many links.  Null ends are left out.
    """
    ends = links.where("a is not null and b is not null").select("a", "b")
    edges = write_shared(ends.where("a <> b").union(ends.where("a <> b").select(F.col("b"), F.col("a"))).distinct().toDF("a", "b"), "cc-edges")
    labels = write_shared(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "cc-labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).select(edges.a.alias("node"), "component")
        seen = write_shared(near.union(labels).groupBy("node").agg(F.min("component").alias("component")), "cc-seen")
        # the label of the label, which may be smaller still
        far = seen.select(F.col("node").alias("label"), F.col("component").alias("beyond"))
        joined = seen.join(far, seen.component == far.label, "left").select("node", F.least("component", "beyond").alias("component"))
        new = write_shared(joined, "cc-labels")
        changed = new.join(labels.select("node", F.col("component").alias("before")), "node").where("component <> before").limit(1).count()
        labels = new
        if not changed:
            return labels
