"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the edges (a, b); root is the component's smallest id.

    Every round an id takes the smallest root among its neighbours, then its
    root's root, until nothing changes: a logarithmic number of rounds in
    practice.  Minima are combined before the shuffle, and each round is cut off
    in the shared folder.
    """
    both = common.cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    roots = common.cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")))
    while True:
        near = (
            both.join(roots, both["b"] == roots["id"]).groupBy("a").agg(F.min("root").alias("near"))
        )
        lower = roots.join(near, roots["id"] == near["a"]).select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        lower = common.cut_lineage(lower)
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("above"))
        roots = common.cut_lineage(lower.join(jump, "root").select("id", F.least("root", "above").alias("root"), "was"))
        if roots.where("root != was").isEmpty():
            return roots.select("id", "root")
