"""Joins by distance over grid cells, in any planar unit.

The small side is put into the cells around it, so each pair within reach meets
in a cell by an equality join; an exact filter follows. Long segments register
in every cell that their box touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import along, cell, point_segment


def box_cells(lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, size: int) -> Column:
    """Rows for all cells that a box meets."""
    xs = F.sequence(cell(lo_x, size), cell(hi_x, size))
    ys = F.sequence(cell(lo_y, size), cell(hi_y, size))
    return F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))


def meet_in_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b that share a cell (cx, cy). Always by a shuffle of both: the rows of a box's cells are many times
    what Spark expects of the explode, so that it would send them to the driver and to all tasks as a small table.
    """
    return a.join(b.hint("merge"), ["cx", "cy"])


def points_near_points(left: DataFrame, right: DataFrame, reach: int, lx: str = "px", ly: str = "py", rx: str = "qx", ry: str = "qy") -> DataFrame:
    """Pairs at distance up to reach, with d2 (squared distance)."""
    a = left.withColumns({"cx": cell(F.col(lx), reach), "cy": cell(F.col(ly), reach)})
    b = right.withColumn("_c", box_cells(F.col(rx) - reach, F.col(rx) + reach, F.col(ry) - reach, F.col(ry) + reach, reach)).select("*", "_c.cx", "_c.cy").drop("_c")
    d2 = (F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry))
    return meet_in_cells(a, b).withColumn("d2", d2).filter(F.col("d2") <= reach * reach).drop("cx", "cy")


def points_near_segments(points: DataFrame, segments: DataFrame, reach: int, px: str = "px", py: str = "py") -> DataFrame:
    """Pairs of a point and a segment (ux, uy, vx, vy) at distance up to reach, with d and frac."""
    a = points.withColumns({"cx": cell(F.col(px), 4 * reach), "cy": cell(F.col(py), 4 * reach)})
    box = box_cells(F.least("ux", "vx") - reach, F.greatest("ux", "vx") + reach, F.least("uy", "vy") - reach, F.greatest("uy", "vy") + reach, 4 * reach)
    b = segments.withColumn("_c", box).select("*", "_c.cx", "_c.cy").drop("_c")
    at = [F.col(c).cast("double") for c in (px, py, "ux", "uy", "vx", "vy")]
    return meet_in_cells(a, b).withColumns({"d": point_segment(*at), "frac": along(*at)}).filter(F.col("d") <= reach).drop("cx", "cy")


def nearest(pairs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's candidates the first in order; ties need further columns in order."""
    rest = [c for c in pairs.columns if c not in (key, *order)]
    best = pairs.groupBy(key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_x"))  # combines before the shuffle
    return best.select(key, "_x.*").select(*pairs.columns)


def segment_in_box_share(ux: Column, uy: Column, vx: Column, vy: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Share of a segment's length inside an axis-parallel box (clipping parameter interval)."""
    def axis(a: Column, b: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        d = b - a
        inside = (a >= lo) & (a <= hi)
        enter = F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least((lo - a) / d, (hi - a) / d))
        leave = F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest((lo - a) / d, (hi - a) / d))
        return enter, leave

    (ex, lx), (ey, ly) = axis(ux, vx, x0, x1), axis(uy, vy, y0, y1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lx, ly) - F.greatest(F.lit(0.0), ex, ey))


def segments_near_segments(a: DataFrame, b: DataFrame, reach: int, size: int = 1000) -> DataFrame:
    """Pairs of segments (a: ax, ay, bx, by; b: ux, uy, vx, vy) at distance up to reach; each pair once."""
    box_a = box_cells(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach, F.least("ay", "by") - reach, F.greatest("ay", "by") + reach, size)
    box_b = box_cells(F.least("ux", "vx"), F.greatest("ux", "vx"), F.least("uy", "vy"), F.greatest("uy", "vy"), size)
    put = lambda d, box: d.withColumn("_c", box).select("*", "_c.cx", "_c.cy").drop("_c")
    pairs = meet_in_cells(put(a, box_a), put(b, box_b)).drop("cx", "cy").distinct()
    ax, ay, bx, by, ux, uy, vx, vy = [F.col(c).cast("double") for c in ("ax", "ay", "bx", "by", "ux", "uy", "vx", "vy")]
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    cross = (side(ax, ay, bx, by, ux, uy) * side(ax, ay, bx, by, vx, vy) < 0) & (side(ux, uy, vx, vy, ax, ay) * side(ux, uy, vx, vy, bx, by) < 0)
    ends = F.least(point_segment(ax, ay, ux, uy, vx, vy), point_segment(bx, by, ux, uy, vx, vy), point_segment(ux, uy, ax, ay, bx, by), point_segment(vx, vy, ax, ay, bx, by))
    return pairs.filter(cross | (ends <= reach))


def corridor_share(reach: float, a: tuple[str, ...] = ("ax", "ay", "bx", "by"), e: tuple[str, ...] = ("ux", "uy", "vx", "vy")) -> Column:
    """Share of segment e that lies within reach of segment a. What lies within reach is convex, so it is one interval of e."""
    ax, ay, bx, by = [F.col(c).cast("double") for c in a]
    ux, uy, vx, vy = [F.col(c).cast("double") for c in e]
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    cx, cy = (bx - ax) / length, (by - ay) / length
    along_of = lambda x, y: (x - ax) * cx + (y - ay) * cy
    off_of = lambda x, y: (y - ay) * cx - (x - ax) * cy
    s0, s1, o0, o1 = along_of(ux, uy), along_of(vx, vy), off_of(ux, uy), off_of(vx, vy)

    def strip(p: Column, q: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        d = q - p
        flat = F.abs(d) < 1e-9
        inside = (p >= lo) & (p <= hi)
        return F.when(flat, F.when(inside, -1e18).otherwise(1e18)).otherwise(F.least((lo - p) / d, (hi - p) / d)), F.when(flat, F.when(inside, 1e18).otherwise(-1e18)).otherwise(F.greatest((lo - p) / d, (hi - p) / d))

    (e1, l1), (e2, l2) = strip(s0, s1, F.lit(0.0), length), strip(o0, o1, F.lit(-float(reach)), F.lit(float(reach)))
    spans = [(F.greatest(e1, e2), F.least(l1, l2))]
    for px, py in ((ax, ay), (bx, by)):
        dx, dy = vx - ux, vy - uy
        qa, qb, qc = dx * dx + dy * dy, (ux - px) * dx + (uy - py) * dy, (ux - px) * (ux - px) + (uy - py) * (uy - py) - float(reach) ** 2
        disc = qb * qb - qa * qc
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        spans.append((F.when(disc < 0, 1e18).otherwise((-qb - root) / qa), F.when(disc < 0, -1e18).otherwise((-qb + root) / qa)))
    cut = [(F.greatest(F.lit(0.0), s), F.least(F.lit(1.0), t)) for s, t in spans]
    first = F.least(*[F.when(s < t, s).otherwise(2.0) for s, t in cut])
    last = F.greatest(*[F.when(s < t, t).otherwise(-2.0) for s, t in cut])
    return F.greatest(F.lit(0.0), last - first)
