"""Geometry on columns: distances, bearings, grid cells and the sun."""

from __future__ import annotations

import math

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two directions, 0 to 90: opposite directions count as parallel; 0 for a zero vector."""
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cos = F.least(F.lit(1.0), F.abs(ax * bx + ay * by) / norm)
    return F.when(norm == 0, 0.0).otherwise(F.degrees(F.acos(cos)))


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Fraction of the segment a-b at which the foot of p lies, 0 to 1."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n)))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along(px, py, ax, ay, bx, by)
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), F.lit(2)) + F.pow(py - (ay + t * (by - ay)), F.lit(2)))


def cell(v: Column, size: int) -> Column:
    return F.floor(v / size).cast("long")


def solar_elevation_deg(ts: Column, lat: float = 51.5074, lon: float = -0.1278) -> Column:
    """Sun above the horizon in degrees at a UTC time, low accuracy formula."""
    d = (F.unix_micros(ts) / 1e6 - 946728000.0) / 86400.0
    mod = lambda x, m: x - F.floor(x / m) * m
    g = F.radians(mod(357.529 + d * 0.98560028, 360.0))
    lam = F.radians(mod(280.459 + d * 0.98564736, 360.0) + 1.915 * F.sin(g) + 0.020 * F.sin(g * 2))
    e = F.radians(23.439 - d * 0.00000036)
    ra = F.atan2(F.cos(e) * F.sin(lam), F.cos(lam))
    dec = F.asin(F.sin(e) * F.sin(lam))
    ha = F.radians(mod(mod(18.697374558 + d * 24.06570982441908, 24.0) * 15.0 + lon, 360.0)) - ra
    la = F.radians(F.lit(lat))
    return F.degrees(F.asin(F.sin(la) * F.sin(dec) + F.cos(la) * F.cos(dec) * F.cos(ha)))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres of the spherical Mercator projection."""
    return F.radians(lon) * MERCATOR_M, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(F.atan(F.exp(y / MERCATOR_M)) * 2 - math.pi / 2)


def barrier_confidence(off_u: Column, curve: Column, threshold_m: float = 4.0) -> Column:
    """How surely a barrier off a street (microdegrees) blocks it: by distance where the street is straight (curve: its length over the straight line), else a half."""
    return F.when(curve.isNull() | (curve > 1.05), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - off_u / 1e6 * 111_000 / threshold_m))


#: Half axes of the ellipsoids, metres.
WGS84, AIRY = (6_378_137.0, 6_356_752.314245), (6_377_563.396, 6_356_256.909)
#: Shift (metres), scale (parts in a million) and turns (seconds of arc) from WGS84 to the British datum.
SHIFT, SCALE_PPM, TURNS = (-446.448, 125.157, -542.060), 20.4894, (-0.1502, -0.2470, -0.8421)
#: Fixed values of the national grid: scale on the central meridian, its longitude and the true origin's latitude (degrees), false origin (metres).
GRID_SCALE, GRID_LON, GRID_LAT, GRID_EAST, GRID_NORTH = 0.9996012717, -2.0, 49.0, 400_000.0, -100_000.0


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body over values that are computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def shift_datum(lon: Column, lat: Column, to_british: bool = True) -> Column:
    """Struct (lon, lat) in degrees on the other datum, at height 0: the seven-parameter shift, within some 5 metres of the ground truth."""
    sign = 1.0 if to_british else -1.0
    (a, b), (ta, tb) = (WGS84, AIRY) if to_british else (AIRY, WGS84)
    e2, te2 = 1 - (b / a) ** 2, 1 - (tb / ta) ** 2
    k = 1 + sign * SCALE_PPM * 1e-6
    rx, ry, rz = (sign * math.radians(r / 3600) for r in TURNS)
    dx, dy, dz = (sign * d for d in SHIFT)

    def turned(s: Column) -> Column:
        x = s["n"] * F.cos(s["f"]) * F.cos(s["l"])
        y = s["n"] * F.cos(s["f"]) * F.sin(s["l"])
        z = s["n"] * (1 - e2) * F.sin(s["f"])
        return _let(back, x=dx + k * x - rz * y + ry * z, y=dy + rz * x + k * y - rx * z, z=dz - ry * x + rx * y + k * z)

    def back(s: Column) -> Column:
        p = F.sqrt(s["x"] * s["x"] + s["y"] * s["y"])
        # Bowring's closed form, far below a micrometre on the ground
        return _let(lambda q: F.struct(F.degrees(F.atan2(q["y"], q["x"])).alias("lon"), F.degrees(F.atan2(q["z"] + te2 * ta * ta / tb * F.pow(F.sin(q["u"]), F.lit(3)), q["p"] - te2 * ta * F.pow(F.cos(q["u"]), F.lit(3)))).alias("lat")), x=s["x"], y=s["y"], z=s["z"], p=p, u=F.atan2(s["z"] * ta, p * tb))

    f = F.radians(lat)
    return _let(turned, f=f, l=F.radians(lon), n=a / F.sqrt(1 - e2 * F.pow(F.sin(f), F.lit(2))))


def _series() -> tuple[float, list[float], list[float], list[float], float]:
    """Radius of the rectified sphere, coefficients towards the plane, back, and of the latitude from the conformal one, and the eccentricity, on the grid's ellipsoid (to the fourth power of the third flattening)."""
    a, b = AIRY
    n = (a - b) / (a + b)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    plane = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    lat = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, plane, back, lat, math.sqrt(1 - (b / a) ** 2)


def _meridian() -> float:
    """The true origin's distance from the equator on the rectified sphere, in radians."""
    _, plane, _, _, e = _series()
    s = math.sin(math.radians(GRID_LAT))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(plane))


def to_grid(lon: Column, lat: Column) -> Column:
    """Struct (east, north): metres of the British national grid for degrees on the British datum, by the transverse Mercator series."""
    radius, plane, _, _, e = _series()
    scale = GRID_SCALE * radius

    def placed(s: Column) -> Column:
        xi, eta = s["xi"], s["eta"]
        north = xi + sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(plane))
        east = eta + sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(plane))
        return F.struct((GRID_EAST + scale * east).alias("east"), (GRID_NORTH + scale * (north - _meridian())).alias("north"))

    def conformal(s: Column) -> Column:
        return _let(placed, xi=F.atan2(s["t"], F.cos(s["l"])), eta=F.atanh(F.sin(s["l"]) / F.sqrt(1 + s["t"] * s["t"])))

    sin = F.sin(F.radians(lat))
    return _let(conformal, t=F.sinh(F.atanh(sin) - e * F.atanh(e * sin)), l=F.radians(lon - GRID_LON))


def from_grid(east: Column, north: Column) -> Column:
    """Struct (lon, lat): degrees on the British datum for metres of the national grid."""
    radius, _, back, series, _ = _series()
    scale = GRID_SCALE * radius

    def conformal(s: Column) -> Column:
        xi = s["x"] - sum(c * F.sin(2 * (j + 1) * s["x"]) * F.cosh(2 * (j + 1) * s["y"]) for j, c in enumerate(back))
        eta = s["y"] - sum(c * F.cos(2 * (j + 1) * s["x"]) * F.sinh(2 * (j + 1) * s["y"]) for j, c in enumerate(back))
        return _let(lambda q: _let(placed, chi=F.asin(F.sin(q["xi"]) / F.cosh(q["eta"])), l=F.atan2(F.sinh(q["eta"]), F.cos(q["xi"]))), xi=xi, eta=eta)

    def placed(s: Column) -> Column:
        lat = s["chi"] + sum(c * F.sin(2 * (j + 1) * s["chi"]) for j, c in enumerate(series))
        return F.struct((F.degrees(s["l"]) + GRID_LON).alias("lon"), F.degrees(lat).alias("lat"))

    return _let(conformal, x=(north - GRID_NORTH) / scale + _meridian(), y=(east - GRID_EAST) / scale)


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 8) -> Column:
    """Length of the shortest line on the WGS84 ellipsoid, metres: the longitude on the auxiliary sphere by a fixed number of rounds.

    Eight rounds are exact to a tenth of a millimetre up to some 15,000 km; points almost opposite each other would need more.
    On short lines the sines cancel, so that the last bit of one is some 1e-6 mm. The JVM has sines of its own, which
    differ there from the C library's, so the rounds run on Arrow's functions, which are the C library's.
    """
    a, b = WGS84
    f = (a - b) / a

    @F.arrow_udf("double")
    def metres(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
        of = lambda name, *xs: getattr(pc, name)(*(pa.array(x, pa.float64()) for x in xs)).to_numpy(zero_copy_only=False)
        radians = lambda x: x * (math.pi / 180)
        over = lambda x, y: np.where(y == 0, 0.0, x / np.where(y == 0, 1.0, y))
        ends = [x.cast(pa.float64()) for x in (x1, y1, x2, y2)]
        lon1, lat1, lon2, lat2 = (x.to_numpy(zero_copy_only=False) for x in ends)
        u1, u2 = (of("atan", (1 - f) * of("tan", radians(x))) for x in (lat1, lat2))
        s1, c1, s2, c2 = of("sin", u1), of("cos", u1), of("sin", u2), of("cos", u2)
        lam = l = radians(lon2 - lon1)
        for k in range(rounds + 1):
            sl, cl = of("sin", lam), of("cos", lam)
            p, q = c2 * sl, c1 * s2 - s1 * c2 * cl
            sin, cos = np.sqrt(p * p + q * q), s1 * s2 + c1 * c2 * cl
            alpha = over(c1 * c2 * sl, sin)
            square = 1 - alpha * alpha
            # on the equator the middle has no meaning, and its factor is 0
            mid, arc = np.where(square == 0, 0.0, cos - over(2 * s1 * s2, square)), of("atan2", sin, cos)
            if k < rounds:
                c = f / 16 * square * (4 + f * (4 - 3 * square))
                lam = l + (1 - c) * f * alpha * (arc + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
        u = square * ((a * a - b * b) / (b * b))
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        off = small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)))
        none = np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in ends])
        return pa.array(b * big * (arc - off), pa.float64(), mask=none)

    return metres(lon1, lat1, lon2, lat2)
