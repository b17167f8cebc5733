"""Rings, buffered lines and discs as column expressions: shares of segments, hulls, rectangles.

A zone is an array of points (x, y). What lies inside a zone is cut out of a
segment by the places where it may enter or leave; between two of them one point
tells for all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.geo import _let


def _sides(ring: Column) -> Column:
    """The ring's sides as (p, q)."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.get(ring, (i + 1) % F.size(ring)).alias("q")))


def _d(c: Column) -> Column:
    return c.cast("double")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring, by its winding number; a point on a side counts as inside."""
    def turn(s: Column) -> Column:
        px, py, qx, qy = _d(s["p"]["x"]), _d(s["p"]["y"]), _d(s["q"]["x"]), _d(s["q"]["y"])
        left = (qx - px) * (y - py) - (x - px) * (qy - py)
        on = (F.abs(left) <= 1e-6 * (F.abs(qx - px) + F.abs(qy - py))) & x.between(F.least(px, qx), F.greatest(px, qx)) & y.between(F.least(py, qy), F.greatest(py, qy))
        return F.when(on, 1_000_000).when((py <= y) & (qy > y) & (left > 0), 1).when((py > y) & (qy <= y) & (left < 0), -1).otherwise(0)

    return F.aggregate(_sides(ring), F.lit(0), lambda n, s: n + turn(s)) != 0


def _share(places: Column, inside) -> Column:
    """Length between neighbours of the sorted places (0 to 1) where inside(middle) holds."""
    at = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), places))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"))
    step = lambda s, t: F.struct((s["sum"] + F.when((t > s["last"]) & inside((t + s["last"]) / 2), t - s["last"]).otherwise(0.0)).alias("sum"), t.alias("last"))
    return F.aggregate(at, start, step)["sum"]


def _valid(t: Column) -> Column:
    return t.isNotNull() & (t > 0) & (t < 1)


def ring_share(segment: tuple[Column, Column, Column, Column], ring: Column) -> Column:
    """Share of a segment's length inside a ring, of any shape and direction."""
    ux, uy, vx, vy = map(_d, segment)

    def place(s: Column) -> Column:
        px, py = _d(s["p"]["x"]), _d(s["p"]["y"])
        ex, ey = _d(s["q"]["x"]) - px, _d(s["q"]["y"]) - py
        across = (vx - ux) * ey - (vy - uy) * ex
        t = F.try_divide((px - ux) * ey - (py - uy) * ex, across)
        s_at = F.try_divide((px - ux) * (vy - uy) - (py - uy) * (vx - ux), across)
        # sides on the segment's own line: its corners are the places
        return F.when(s_at.between(0.0, 1.0), t).when((across == 0) & ((px - ux) * (vy - uy) - (py - uy) * (vx - ux) == 0), F.try_divide((px - ux) * (vx - ux) + (py - uy) * (vy - uy), (vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)))

    places = F.filter(F.transform(_sides(ring), place), _valid)
    return _share(places, lambda t: in_ring(ux + t * (vx - ux), uy + t * (vy - uy), ring))


def _squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy))), F.lit(0.0))
    ex, ey = px - ax - t * dx, py - ay - t * dy
    return ex * ex + ey * ey


def line_share(segment: tuple[Column, Column, Column, Column], line: Column, reach: Column) -> Column:
    """Share of a segment's length within reach of a line of several points; of one point, within its disc."""
    ux, uy, vx, vy = map(_d, segment)
    dx, dy, r = vx - ux, vy - uy, _d(reach)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), lambda i: F.struct(F.get(line, i).alias("p"), F.get(line, F.least(i + 1, F.size(line) - 1)).alias("q")))

    def disc(p: Column) -> list[Column]:
        """Where the segment's line meets the circle around p."""
        fx, fy = ux - _d(p["x"]), uy - _d(p["y"])
        a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - r * r
        root = F.when(b * b - a * c >= 0, F.sqrt(F.greatest(b * b - a * c, F.lit(0.0))))
        return [F.try_divide(-b - root, a), F.try_divide(-b + root, a)]

    def rails(s: Column) -> list[Column]:
        """Where it meets the two parallels of a part at that distance."""
        px, py = _d(s["p"]["x"]), _d(s["p"]["y"])
        ex, ey = _d(s["q"]["x"]) - px, _d(s["q"]["y"]) - py
        off = (ux - px) * ey - (uy - py) * ex
        by, wide = dx * ey - dy * ex, r * F.sqrt(ex * ex + ey * ey)
        return [F.try_divide(wide - off, by), F.try_divide(-wide - off, by)]

    places = F.filter(F.flatten(F.transform(parts, lambda s: F.array(*disc(s["p"]), *disc(s["q"]), *rails(s)))), _valid)

    def near(t: Column) -> Column:
        x, y = ux + t * dx, uy + t * dy
        return F.exists(parts, lambda s: _squared(x, y, _d(s["p"]["x"]), _d(s["p"]["y"]), _d(s["q"]["x"]), _d(s["q"]["y"])) <= r * r)

    return _share(places, near)


def hull(points: Column) -> Column:
    """Convex hull of an array of points (x, y: whole numbers), counter-clockwise, without points on its sides."""
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def chain(sorted_points: Column) -> Column:
        empty = F.slice(sorted_points, 1, 0)

        def add(kept: Column, p: Column) -> Column:
            # along a convex chain the turns towards p are left ones first, so those that stay are a prefix
            stay = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))), lambda i: F.coalesce(turn(F.get(kept, i - 1), F.get(kept, i), p) > 0, F.lit(False))))
            return F.concat(F.slice(kept, F.lit(1), F.when(F.size(kept) < 2, F.size(kept)).otherwise(stay + 1)), F.array(p))

        return F.aggregate(sorted_points, empty, add)

    joined = lambda s: F.concat(F.slice(s["lower"], F.lit(1), F.size(s["lower"]) - 1), F.slice(s["upper"], F.lit(1), F.size(s["upper"]) - 1))
    both = lambda s: F.when(F.size(s["ordered"]) < 3, s["ordered"]).otherwise(_let(joined, lower=chain(s["ordered"]), upper=chain(F.reverse(s["ordered"]))))
    return _let(both, ordered=F.array_sort(F.array_distinct(points)))


def long_axis(points: Column) -> Column:
    """(dx, dy) along the longer side of the smallest rectangle around the points; the rectangle lies on a side of their hull."""
    def rectangle(own: Column, s: Column) -> Column:
        dx, dy = _d(s["q"]["x"] - s["p"]["x"]), _d(s["q"]["y"] - s["p"]["y"])
        along = F.transform(own, lambda p: _d(p["x"]) * dx + _d(p["y"]) * dy)
        off = F.transform(own, lambda p: _d(p["y"]) * dx - _d(p["x"]) * dy)
        width, height = F.array_max(along) - F.array_min(along), F.array_max(off) - F.array_min(off)
        longer = width >= height
        return F.struct(F.try_divide(width * height, dx * dx + dy * dy).alias("area"), F.when(longer, dx).otherwise(-dy).alias("dx"), F.when(longer, dy).otherwise(dx).alias("dy"))

    # a lambda works out again for each side what it doesn't get as a value
    return _let(lambda h: F.array_min(F.filter(F.transform(_sides(h["own"]), lambda s: rectangle(h["own"], s)), lambda r: r["area"].isNotNull())), own=hull(points))
