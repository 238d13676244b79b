"""Connected components of a table of links, as joins and aggregates only.

Alternating large and small stars (Kiveris et al., 2014): each step hooks neighbours
to the smallest node seen, and the links end up as one star per component. Tables are
written to the shared folder between steps, so a lost executor costs one step, and a
hub with any share of the links is a skewed join of two written tables, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.plans.staging import release, shuffles_removed, stage


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component`` for each node with a link to another node.

    ``component`` is the smallest node reachable. Links in either direction, repeated
    links, links of a node to itself and NULL ends are fine (the last two count for
    nothing); no links give no rows.
    """
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    stars = stage(_oriented(ends).distinct(), "links")
    while not _is_stars(stars):
        both = stars.union(stars.select(F.col("low").alias("high"), F.col("high").alias("low")))
        nearest = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        nearest = stage(nearest.select("node", F.least("node", "least").alias("least")), "nearest")
        large = stars.join(nearest, stars["low"] == nearest["node"])
        large = stage(_oriented(large.select(F.col("high").alias("a"), F.col("least").alias("b"))).distinct(), "large")
        first = stage(large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least")), "first")
        small = large.join(first, large["high"] == first["node"])
        small = small.select(F.col("low").alias("a"), F.col("least").alias("b")).union(first)
        before = stars
        stars = stage(_oriented(small.where("a <> b")).distinct(), "links")
        release(before, nearest, large, first)
    centres = stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).union(centres)


def _oriented(ends: DataFrame) -> DataFrame:
    return ends.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))


def _is_stars(links: DataFrame) -> bool:
    """Whether no node hangs on two others, or is hung on while hanging itself; one job."""
    hung = links.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = hung.union(links.select("low", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    with shuffles_removed(links.sparkSession):
        return counts.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
