"""Connected components by alternating large-star and small-star rounds.

A large-star round points every larger neighbour of a node at the smallest node around it, a small-star round does
the same with the smaller neighbours; rounds alternate until every node points at one node, the smallest of its
component, and that one at none.  A round is an aggregate and a join on thin (node, node) rows: no neighbour list
is ever collected, and each round is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import cut


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one node, and that one at none."""
    up = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """``links`` have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``u, v`` links; nodes are longs.

    Repeated links and links in either direction do not matter, self links and links with a null end are ignored.
    """
    known = links.where("u is not null and v is not null and u <> v")
    stars = cut(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(stars):
        stars = cut(small_star(large_star(stars)))
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
