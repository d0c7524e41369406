"""Connected components of a link table by alternating star steps, all in Spark.

A large star links every larger neighbour of a node to the node's smallest neighbour; a small star links the others. Both
keep the components and shorten paths, so rounds grow with the logarithm of the longest path. Joins are plain equi-joins
on node, which adaptive execution splits when one node has a large share of the links.

Defined results: a link with a null end is none; repeated links and both directions count once; loops are ignored; an empty table gives no rows; columns other
than u and v aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(links: DataFrame) -> DataFrame:
    both = _both(links)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("node")).select(F.col("m").alias("u"), "v").where("u < v")


def _small(links: DataFrame) -> DataFrame:
    """links: u < v. Every v keeps its smallest neighbour, and its other smaller neighbours are linked to that one."""
    low = links.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("node"), "m")
    moved = links.join(low, F.col("v") == F.col("node")).where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(low.select(F.col("m").alias("u"), F.col("node").alias("v")))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link. links: (u, v), in any order; loops are ignored."""
    now = scratch.save(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    mark = None
    while True:
        after = scratch.save(_small(_large(now)).distinct())
        scratch.drop(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        if seen == mark:
            break
        mark = seen
    # At the fixed point every link goes from a component's smallest node to one of the others.
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
