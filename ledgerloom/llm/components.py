"""Connected components of a table of links, by alternating stars (large star, small star).

Every round replaces links by links to the least neighbour; both steps are a grouped
minimum and a join back, so no component gathers in one task, and rounds grow with the
logarithm of the longest path. A round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v): each u's larger (or smaller) neighbours to u's least neighbour or u itself."""
    if large:
        near = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (u, v: no nulls) that isn't its own."""
    links = scratch.table(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    old = scratch.last
    while True:
        links = scratch.table(_star(_star(links, True), False), "links")
        # Done when nothing changes: the links are a set, so a count and a sum of hashes tell.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old:
            scratch.drop(old)
        old = scratch.last
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
