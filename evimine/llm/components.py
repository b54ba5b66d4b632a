"""Connected components of links, by alternating large and small stars.

Each round replaces every link by links to the smallest neighbour; a few rounds leave a star per component. Rounds are
joins with one row per node, so a node with very many links is spread by the planner, and every round is written to
the shared folder. Nothing is collected but whether they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimine.llm._spark import cut


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b, in any order, repeated or not, those with a null end left out; without links no rows. Returns node and root, the smallest node it reaches, for all nodes that have a link to another and are not that root."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _stars(edges):
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none."""
    own = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("m"))
    seen = edges.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("m")).distinct()
    both = own.unionByName(seen).groupBy("u").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    return both.where("n > 1 OR (n > 0 AND m > 0)").isEmpty()
