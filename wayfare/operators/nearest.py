"""The nearest target at any distance, by squares that halve only where targets are dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import settle

#: Squares of a level that may be broadcast: their number is at most four to the power of the levels above.
FEW = 4096


def _off(p: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - p, p - hi, F.lit(0))


def nearest_at_any_distance(points: DataFrame, targets: DataFrame, target: str, cap: int = 64, step: int = 2) -> DataFrame:
    """id, target, d2: each point's (id, px, py) nearest target (target, qx, qy), the least one among equals.

    Squares of targets are halved step times a round. A square's box of targets tells how near and how far its nearest
    target may be: squares that begin farther off than another one ends are left. Squares of at most cap places are
    looked through, so no square joins more than cap places to a point, however dense the targets are; targets at one
    place count as one. Upper levels are broadcast (at most FEW squares), lower ones join by square, where a square's
    points may be split since its own row is single. Ids of points are unique. Places are whole numbers; points and
    targets without a place take no part, and without any target there are no rows.
    """
    places = settle(targets.filter("qx IS NOT NULL AND qy IS NOT NULL").groupBy("qx", "qy").agg(F.min(target).alias(target)))
    x0, x1, y0, y1 = places.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()
    points = points.filter("px IS NOT NULL AND py IS NOT NULL").select("id", "px", "py")
    if x0 is None:
        return points.limit(0).select("id", F.lit(None).cast(targets.schema[target].dataType).alias(target), F.lit(0).cast("bigint").alias("d2"))
    top = max(x1 - x0, y1 - y0, 1).bit_length()
    places = places.withColumns({"sx": F.col("qx") - x0, "sy": F.col("qy") - y0})
    left, out, level = points.withColumns({"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint"), "bound": F.lit(None).cast("bigint")}), None, top
    while True:
        down = min(step, level)
        level -= down
        at = places.withColumns({"nx": F.shiftright("sx", level), "ny": F.shiftright("sy", level)})
        squares = at.groupBy("nx", "ny").agg(F.count("*").alias("n"), *[f(c).alias(a) for f, c, a in ((F.min, "qx", "bx0"), (F.max, "qx", "bx1"), (F.min, "qy", "by0"), (F.max, "qy", "by1"))])
        squares = squares.withColumns({"cx": F.shiftright("nx", down), "cy": F.shiftright("ny", down)})
        # of what is met in squares Spark's estimate is too low to leave the choice to it
        squares = F.broadcast(squares) if 4 ** (top - level) <= FEW else squares.hint("merge")
        ox, oy = _off(F.col("px"), F.col("bx0"), F.col("bx1")), _off(F.col("py"), F.col("by0"), F.col("by1"))
        fx, fy = (F.greatest(F.abs(F.col(p) - F.col(a)), F.abs(F.col(p) - F.col(b))) for p, a, b in (("px", "bx0", "bx1"), ("py", "by0", "by1")))
        met = left.join(squares, ["cx", "cy"]).withColumns({"begin": ox * ox + oy * oy, "end": fx * fx + fy * fy})
        # rows of a point are its squares that are still open, times their parts
        met = met.withColumn("bound", F.least("bound", F.min("end").over(Window.partitionBy("id")))).filter("begin <= bound")
        met = settle(met.select("id", "px", "py", F.col("nx").alias("cx"), F.col("ny").alias("cy"), "bound", (F.col("n") <= cap).alias("small")))
        small = met if level == 0 else met.filter("small")
        near = small.join(at.withColumnsRenamed({"nx": "cx", "ny": "cy"}).hint("merge"), ["cx", "cy"])
        d2 = (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy"))
        hit = settle(near.groupBy("id").agg(F.min(F.struct(d2.alias("d2"), target)).alias("x")).select("id", f"x.{target}", "x.d2"))
        out = hit if out is None else out.unionByName(hit)
        if level == 0:
            break
        left = met.filter("NOT small").drop("small").join(hit.select("id", F.col("d2").alias("found")).hint("merge"), "id", "left").withColumn("bound", F.least("bound", "found")).drop("found")
        if left.isEmpty():
            break
    return out.groupBy("id").agg(F.min(F.struct("d2", target)).alias("x")).select("id", f"x.{target}", "x.d2")
