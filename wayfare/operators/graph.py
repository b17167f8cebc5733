"""Street graph: directions, duplicates, reverse edges, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = ("yes", "designated", "permissive")


def rideable(ways: DataFrame) -> DataFrame:
    """Ways a bicycle may use: none with bicycle=no, motorways only with a positive bicycle tag."""
    return ways.filter((F.col("bicycle") != "no") & ((F.col("type") != "motorway") | F.col("bicycle").isin(*POSITIVE)))


def directed_edges(ways: DataFrame) -> DataFrame:
    """Directed edges (u, v) with `back`, by oneway and contraflow tags."""
    open_ways = rideable(ways)
    both = F.col("oneway_bicycle") == "no"
    ahead = open_ways.filter((F.col("oneway") != "-1") | both).withColumn("back", F.lit(0))
    back = open_ways.filter(~F.col("oneway").isin("yes", "true", "1") | both).withColumn("back", F.lit(1))
    back = back.withColumns({"u": F.col("v"), "v": F.col("u")})
    return ahead.unionByName(back)


def last_wins(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each (u, v): the last in the given order."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    best = edges.groupBy("u", "v").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))  # combines before the shuffle
    return best.select("u", "v", "_x.*").select(*edges.columns)


def with_reverse(updates: DataFrame, edges: DataFrame) -> DataFrame:
    """updates (u, v, ...) also applied to (v, u), as far as that edge exists."""
    swapped = updates.withColumns({"u": F.col("v"), "v": F.col("u")})
    return updates.unionByName(swapped.join(edges.select("u", "v").distinct(), ["u", "v"], "left_semi")).distinct()


def car_roads(edges: DataFrame, no_cars: tuple[str, ...]) -> DataFrame:
    """node_id, roads: distinct neighbours over edges that cars may use, either direction."""
    cars = edges.filter(~F.col("type").isin(*no_cars))
    pair = cars.select(F.explode(F.array(F.struct(F.col("u").alias("node_id"), F.col("v").alias("o")), F.struct(F.col("v").alias("node_id"), F.col("u").alias("o")))).alias("p")).select("p.*")
    return pair.groupBy("node_id").agg(F.count_distinct("o").alias("roads"))


def csr(edges: DataFrame) -> DataFrame:
    """u with its ordered out-edges as an array of (v, cost)."""
    return edges.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("v", "cost"))).alias("out"))


def in_ellipse(x: Column, y: Column, sx: Column, sy: Column, tx: Column, ty: Column, factor: float = 1.5) -> Column:
    """Whether the way from s over (x, y) to t is at most factor times the straight line."""
    d = lambda a, b, c, e: F.sqrt(F.pow((a - c).cast("double"), F.lit(2)) + F.pow((b - e).cast("double"), F.lit(2)))
    return d(sx, sy, x, y) + d(x, y, tx, ty) <= d(sx, sy, tx, ty) * factor
