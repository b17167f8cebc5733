"""What lies within a distance of many nodes along streets: rounds of relaxation until no distance gets shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.session import settle

#: Hops of a round, between two writes.
HOPS = 3


def expand(links: DataFrame, sources: DataFrame, limit: int, past: bool = False, barred: DataFrame | None = None) -> DataFrame:
    """source, node, dist: the nodes that links (u, v, cost) reach from each source (source, node) within limit, with the
    least distance; a source reaches itself at 0.

    With past, nodes at or beyond the limit appear too where the way before them stays under it, and none goes on from
    there. barred (source, node) are nodes that a source may not enter. Each round goes on for HOPS hops from what
    the last one improved only, until nothing does, whatever the number of hops of the longest cheapest way. Costs
    are 0 or more; null nodes and costs take no part; of parallel links the cheapest counts. Links and barred nodes are
    shuffled: as broadcasts they would pass through the driver in each hop.
    """
    links = links.filter("u IS NOT NULL AND v IS NOT NULL AND cost >= 0" + ("" if past else f" AND cost <= {limit}"))
    links = settle(links.groupBy("u", "v").agg(F.min("cost").cast("bigint").alias("cost")))
    best = settle(sources.filter("source IS NOT NULL AND node IS NOT NULL").select("source", "node").distinct().select("source", "node", F.lit(0).cast("bigint").alias("dist"), F.lit(True).alias("new")))
    while True:
        frontier = best.filter("new" + (f" AND dist < {limit}" if past else ""))
        if frontier.isEmpty():
            return best.select("source", "node", "dist")
        both = best.withColumn("new", F.lit(False))
        for _ in range(HOPS):
            step = frontier.withColumnRenamed("node", "u").join(links.hint("merge"), "u").select("source", F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"))
            if not past:
                step = step.filter(F.col("dist") <= limit)
            if barred is not None:
                step = step.join(barred.hint("merge"), ["source", "node"], "left_anti")
            step = step.groupBy("source", "node").agg(F.min("dist").alias("dist"))
            both = both.unionByName(step.withColumn("new", F.lit(True)))
            frontier = step.filter(F.col("dist") < limit) if past else step
        # of equal distances the known one stays, which isn't new
        best = settle(both.groupBy("source", "node").agg(F.min(F.struct("dist", "new")).alias("x")).select("source", "node", "x.dist", "x.new"))
