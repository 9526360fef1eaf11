"""Connected components of a table of links, by alternating star contractions.

Every round turns each node's neighbours towards its smallest neighbour, first the larger ones
and then the smaller ones, until each component is a star around its smallest node. The number
of rounds grows with the logarithm of the longest path. A node with very many links is an
aggregated minimum and one side of a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrawl.plans.staging import stage


def _larger_to_smallest(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    turned = both.where(F.col("v") > F.col("u")).join(least, "u")
    return turned.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smaller_to_smallest(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    turned = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return turned.union(least).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node that some link (columns u and
    v, any order, repeats and loops allowed, no nulls) joins to another; for no others."""
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(ordered, "links")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = stage(_smaller_to_smallest(_larger_to_smallest(now)), "links")
    inner = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(inner)
