"""Connected components by alternating large-star and small-star contraction (DataFrames only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Links never leave the executors. Each round checkpoints its edges; the number of rounds grows
    with the logarithm of the number of nodes. No links give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = checkpointed(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least neighbour
        e = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, go to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b): only the roots that they tie together are contracted again."""
    if roots is None:
        return checkpointed(connected(links))
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    moved = checkpointed(connected(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    new = moved.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    old = roots.join(new, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    return checkpointed(old.unionByName(moved.join(roots.select("node"), "node", "left_anti")))
