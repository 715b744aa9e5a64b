"""Connected components of a links table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import join_hot, written

HUB = 100  # nodes of more links than this, and of more than one in a thousand, get their least neighbour by broadcast


def _stars(links: DataFrame, larger: bool, total: int) -> DataFrame:
    """Ties each neighbour to the node's least neighbour: the larger ones only, or all the smaller ones and the node.

    `total` is how many links there are at most, each counted at both ends for the larger ones. Least neighbours are written
    first, as whether there are hubs decides how they are joined.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "n", F.least("a", "m").alias("m")))
    hubs = least.where(F.col("n") > max(HUB, total // 1000))
    near = both.join(least.drop("n"), "a") if hubs.isEmpty() else join_hot(both, least, "a", "n", total, HUB)
    if larger:
        new = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of links(a long, b long); component is the least node that can be reached.

    Both halves of a round are written to the shared folder, so a lost executor costs one half at most. Stops when a round
    changes nothing. Partial minima bound what a hub sends, and a hub's links are not joined by key but get the hub's one
    row by broadcast, of at most a thousand hubs; no table is collected. An empty table gives an empty one.
    """
    edges = written(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    seen, links_now = None, edges.count()
    for _ in range(rounds):
        large = written(_stars(edges, True, 2 * links_now))
        edges = written(_stars(large, False, links_now))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, links_now = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
