"""Connected components of links, by large-star and small-star rounds on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def lowest(pairs: DataFrame) -> DataFrame:
    """The least ``v`` of each ``u``.  Dealt out evenly, so that a join can split a ``u`` with many rows."""
    return pairs.groupBy("u").agg(F.min("v").alias("low")).hint("rebalance")


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = both.join(lowest(both), "u")
    return known.where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = down.join(lowest(down), "u")
    moved = known.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(known.select("u", F.col("low").alias("v"))).distinct()


def is_settled(links: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and is no ``v`` itself, so that each ``v`` is the least node of a star."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select(F.col("v").alias("u"), F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where(F.col("up") + F.col("down") > 1).isEmpty()


def roots(links: DataFrame) -> DataFrame:
    """``u`` and ``v`` = the least node of its component, for every linked node but that least one.

    ``links`` has two columns ``u`` and ``v`` of one type, without nulls and self links; each link may stand
    either way round and any number of times.  Rounds go on until all links are stars, about as many as the
    logarithm of the longest path; each is written to the shared folder.
    """
    now = landed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while not is_settled(now):
        now = landed(small_star(large_star(now)), "links")
    return now
