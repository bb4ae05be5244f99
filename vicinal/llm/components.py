"""Connected components of a table of links, by alternating large and small stars.

Every round is a few joins and aggregations with partial aggregates; the links of a node with very
many neighbours are dealt over several tasks; its links are written to
the shared folder, so no lineage grows and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import spread_join
from vicinal.sources import stored


def _loose(links: DataFrame) -> int:
    """Nodes that keep the links from being stars: with two lesser neighbours, or with lesser and greater ones."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").agg(F.count("*")).first()[0]


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("hot_rows"))
    return spread_join(both.filter("v > u"), least.select("u", "m"), "u", ["v"], counted=least.select(F.col("u").alias("hot_key"), "hot_rows")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these; links run from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; root is the least node of its component."""
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    current = stored(ordered, "links")
    while _loose(current):
        current = stored(_small_star(stored(_large_star(current), "large")), "small")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
