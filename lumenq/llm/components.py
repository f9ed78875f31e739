"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm._shared import discard, staged


def _large_star(edges: DataFrame, rows: int, label: str) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node that it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join's sides are plain shuffles, which can be split at a node with very many neighbours
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * rows)
    # a step makes no more edges than it gets, but for one for each node
    out = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label, rows)
    discard(least, edges)
    return out


def _small_star(edges: DataFrame, rows: int, label: str) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = staged(down.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
    out = staged(down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label, 2 * rows)
    discard(least, edges)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, label: str = "stars", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (u, v); component is the smallest node reachable.

    Loops and repeated edges are ignored; an empty table gives an empty result. Every round is written to the shared
    folder, in few files where it is small, and takes the place of the round before; only a row count and a checksum
    come to the driver.
    """
    edges = staged(edges.select("u", "v").where("u <> v").distinct(), label)
    before = _state(edges)
    for _ in range(rounds if before[0] else 0):
        edges = _small_star(_large_star(edges, before[0], label), before[0], label)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
