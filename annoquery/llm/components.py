"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, staged


def _pull(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Each node's neighbours are pulled to the smallest id it knows; minima combine before the shuffle."""
    both = edges if only_smaller else edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    if not only_smaller:
        least = least.select("u", F.least("u", "least").alias("least"))
    out = both.join(least, "u")
    moved = out.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")) if only_smaller else out.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))) if only_smaller else moved


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable from each node that has an edge. ``edges`` has long columns u, v.

    Steps go on until one leaves the edges as they are. Every step writes its edges to the shared folder, so the lineage stays short;
    only two numbers come to the driver.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, seen = staged(edges, "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == seen or not mark[0]:
            break
        seen, old = mark, now
        now = staged(_pull(_pull(now, False).where("u <> v"), True).where("u <> v").distinct(), "edges")
        release(old)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
