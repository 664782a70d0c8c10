"""Connected components by alternating large-star and small-star steps (general helper)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest of each node's ``v`` and itself (map-side combine; a table, so that a join can split hot nodes)."""
    return written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    discard(least, edges)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    out = written(moved.unionByName(own).where("u <> v").distinct(), "small")
    discard(least, edges)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (loops and repeats allowed).

    Each step groups by node with map-side combine and joins the minimum back; both inputs of the join are
    written tables, so a node with very many edges is split by the adaptive skew join.  Rounds grow with
    the logarithm of the longest path, never with the number of edges; only a count and a checksum reach
    the driver.  A round's tables are removed when the next one is written.
    """
    every = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    now = written(every.where("u <> v").distinct(), "edges")
    before = _mark(now)
    while before[0]:
        now = _small_star(_large_star(now))
        after = _mark(now)
        if after == before:
            break
        before = after
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = every.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return named.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
