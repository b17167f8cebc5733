"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


#: Rows of a partition of pairs, about.
SHARE = 100_000


def _star(pairs: DataFrame, large: bool, parts: int) -> DataFrame:
    """pairs (u, v): hooks v to the least of u and its neighbours, for v above u (large) or not above u (small). In parts partitions at most, so that few links don't leave many files in each round."""
    pairs = pairs.coalesce(parts)
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component): component is the least node that the undirected edges reach. Nodes without an edge to another node don't appear."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = -(-(pairs.count() + 1) // SHARE)
    # one small star first: where many nodes hang on the same few, that leaves one link a node and one a pair of those few
    pairs = settle(_star(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), False, parts).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
    before = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        parts = -(-2 * (state["n"] + 1) // SHARE)
        large = _star(_both(pairs), True, parts)
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False, parts)
        pairs = settle(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
