"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

DataFrame operations only. Each round is written to the shared checkpoint folder;
the rounds grow with the logarithm of the longest chain. The minima are written as
tables, so that a node with very many links is a plain join key that adaptive
execution can split; no group of links is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = links.union(links.select("b", "a"))
    least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = cut_lineage(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b); the component is its smallest node.

    Links may be repeated, in either direction, or loops; links with a null end are
    left out, and nodes that only have loops are not returned.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut_lineage(ends.where(links["a"].isNotNull() & links["b"].isNotNull() & (F.col("a") > F.col("b"))).distinct())
    was = None
    while (mark := _digest(now)) != was:
        was = mark
        now = cut_lineage(_small_star(_large_star(now)))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b"), F.col("b")).distinct())
