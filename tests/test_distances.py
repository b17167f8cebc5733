"""Projection and ellipsoid against published points; expansion, nearest targets, ranks and clustered storage against plain searches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfare.functions import geo
from wayfare.operators.expansion import expand
from wayfare.operators.nearest import nearest_at_any_distance
from wayfare.operators.ranking import rank_within
from wayfare.sources import clustered


def degrees(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (1 if d >= 0 else -1)


def test_national_grid_control_point(spark):
    """The worked example of the grid's published guide, to a millimetre, and back."""
    lon, lat = degrees(1, 43, 4.5177), degrees(52, 39, 27.2531)
    p = spark.createDataFrame([(lon, lat)], "lon double, lat double").withColumn("g", geo.to_grid(F.col("lon"), F.col("lat")))
    r = p.select("g.*", geo.from_grid(F.col("g.east"), F.col("g.north")).alias("b")).select("east", "north", "b.*").first()
    assert abs(r["east"] - 651409.903) < 1e-3 and abs(r["north"] - 313177.270) < 1e-3
    assert abs(r["lon"] - lon) < 1e-10 and abs(r["lat"] - lat) < 1e-10


def test_datum_shift(spark):
    """Greenwich's meridian on the British datum lies some 0.0016 degrees off that of WGS84; the way back ends within a centimetre."""
    p = spark.createDataFrame([(0.0, 51.4778)], "lon double, lat double").withColumn("b", geo.shift_datum(F.col("lon"), F.col("lat")))
    r = p.select("b.*", geo.shift_datum(F.col("b.lon"), F.col("b.lat"), False).alias("w")).select("lon", "lat", F.col("w.lon").alias("x"), F.col("w.lat").alias("y")).first()
    assert 0.0014 < r["lon"] < 0.0018 and -0.0007 < r["lat"] - 51.4778 < -0.0003
    assert abs(r["x"]) < 1e-7 and abs(r["y"] - 51.4778) < 1e-7


@pytest.mark.parametrize("ends, metres", [
    ((degrees(144, 25, 29.52440), -degrees(37, 57, 3.72030), degrees(143, 55, 35.38390), -degrees(37, 39, 10.15610)), 54972.271),  # a published line
    ((0.0, 0.0, 1.0, 0.0), 111319.4908),  # a degree of the equator
    ((0.0, 0.0, 0.0, 90.0), 10001965.7293),  # a quarter of a meridian
    ((5.0, 5.0, 5.0, 5.0), 0.0),
])
def test_geodesic(spark, ends, metres):
    got = spark.range(1).select(geo.geodesic_m(*map(F.lit, ends)).alias("m")).first()["m"]
    assert abs(got - metres) < 1e-3


def test_geodesic_rounds_as_the_c_library(spark):
    """A street whose length is half a millimetre but for the last bit of a sine; short lines to the bit; a null end."""
    street = [F.lit(x) / 1e6 for x in (470963, 51967933, 471307, 51968028)]
    assert spark.range(1).select(F.floor(geo.geodesic_m(*street) * 1000 + 0.5).alias("mm")).first()["mm"] == 25898
    r = random.Random(7)
    lines = [(x, y, x + r.randrange(-400, 400) / 1e6, y + r.randrange(1, 400) / 1e6) for x, y in ((r.uniform(-1, 2), r.uniform(50, 53)) for _ in range(500))]
    (a, b), got = geo.WGS84, spark.createDataFrame([*lines, (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double").select("a", "b", "c", "d", geo.geodesic_m(*map(F.col, "abcd")).alias("m")).collect()
    f, seen = (a - b) / a, {tuple(x)[:4]: x["m"] for x in got}
    assert seen[None, 1.0, 2.0, 3.0] is None
    for x1, y1, x2, y2 in lines:
        (s1, c1), (s2, c2) = ((math.sin(u), math.cos(u)) for u in (math.atan((1 - f) * math.tan(math.radians(y))) for y in (y1, y2)))
        lam = l = math.radians(x2 - x1)
        for k in range(9):
            p, q = c2 * math.sin(lam), c1 * s2 - s1 * c2 * math.cos(lam)
            sin, cos = math.sqrt(p * p + q * q), s1 * s2 + c1 * c2 * math.cos(lam)
            alpha = c1 * c2 * math.sin(lam) / sin
            square, arc = 1 - alpha * alpha, math.atan2(sin, cos)
            mid, c = cos - 2 * s1 * s2 / square, f / 16 * square * (4 + f * (4 - 3 * square))
            lam = l + (1 - c) * f * alpha * (arc + c * sin * (mid + c * cos * (2 * mid * mid - 1))) if k < 8 else lam
        u = square * ((a * a - b * b) / (b * b))
        big, small = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        assert seen[x1, y1, x2, y2] == b * big * (arc - small * sin * (mid + small / 4 * (cos * (2 * mid * mid - 1) - small / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3))))


@pytest.mark.parametrize("past", [False, True])
def test_expand(spark, past):
    """Many hops, links of no cost, parallel links, a barred node, null rows, a node without links."""
    r = random.Random(3)
    links = [(r.randrange(40), r.randrange(40), r.choice([0, 1, 2, 5, 9])) for _ in range(110)] + [(1, 2, 7), (1, 2, 3)]
    sources = [(s, s) for s in range(0, 44, 3)]
    barred = {(0, 5), (3, 7), (6, 1)}
    want = set()
    for s, _ in sources:
        best = {s: 0}
        for _ in range(60):
            for u, v, c in links:
                if u in best and (s, v) not in barred and (best[u] < 10 if past else best[u] + c <= 10):
                    best[v] = min(best.get(v, 10**9), best[u] + c)
        want |= {(s, n, d) for n, d in best.items()}
    frame = spark.createDataFrame(links + [(None, 1, 1), (1, None, 1), (1, 2, None)], "u long, v long, cost long")
    got = expand(frame, spark.createDataFrame(sources + [(None, 1)], "source long, node long"), 10, past, spark.createDataFrame(list(barred), "source long, node long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("cap, step", [(1, 1), (4, 2), (64, 3)])
def test_nearest_at_any_distance(spark, cap, step):
    """Targets in one dense heap with repeats, and a few far off; points near, far away and on targets; ties; null places."""
    r = random.Random(cap)
    targets = [(i, 5000 + r.randrange(60), 5000 + r.randrange(60)) for i in range(300)] + [(300 + i, r.randrange(100_000), r.randrange(100_000)) for i in range(12)] + [(400, 5001, 5001), (401, 5001, 5001)]
    points = [(i, r.randrange(-50_000, 150_000), r.randrange(-50_000, 150_000)) for i in range(60)] + [(60 + i, 5000 + r.randrange(70), 5000 + r.randrange(70)) for i in range(60)]
    want = {}
    for i, x, y in points:
        d, t = min(((x - a) ** 2 + (y - b) ** 2, t) for t, a, b in targets)
        want[i] = (t, d)
    p = spark.createDataFrame(points + [(900, None, 3)], "id long, px long, py long")
    t = spark.createDataFrame(targets + [(999, None, 1)], "t long, qx long, qy long")
    got = {i: (t, d) for i, t, d in nearest_at_any_distance(p, t, "t", cap, step).select("id", "t", "d2").collect()}
    assert got == want
    assert nearest_at_any_distance(p, t.limit(0), "t").count() == 0
    assert {tuple(x) for x in nearest_at_any_distance(p, t.filter("t = 400"), "t").select("t").distinct().collect()} == {(400,)}


def test_rank_within(spark):
    """One key with most rows over many ranges, single rows, a null key."""
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 9}", i) for i in range(40)] + [(None, i) for i in range(20)]
    random.Random(1).shuffle(rows)
    got = rank_within(spark.createDataFrame(rows, "k string, i long"), "k", ["i"], "r", partitions=7)
    want = []
    for key in {k for k, _ in rows}:
        want += [(key, i, n + 1) for n, i in enumerate(sorted(i for k, i in rows if k == key))]
    assert sorted(map(tuple, got.select("k", "i", "r").collect()), key=repr) == sorted(want, key=repr)


def test_hilbert_neighbours(spark):
    """Each place once, and places one apart share a side."""
    cells = spark.range(64).select(F.expr("id % 8").alias("x"), F.expr("id div 8").alias("y"))
    order = [(r["x"], r["y"]) for r in cells.select("x", "y", clustered.hilbert(F.col("x"), F.col("y"), 3).alias("h")).orderBy("h").collect()]
    assert len(set(order)) == 64
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:]))


def test_clustered_view_reads_few_files(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, x, x + r.randrange(50), y, y + r.randrange(50)) for i in range(3000) for x, y in [(r.randrange(10_000), r.randrange(10_000))]]
    where, view = str(tmp_path / "c"), (2000, 2000, 6000, 6000)
    clustered.write(spark.createDataFrame(rows, "id long, x0 long, x1 long, y0 long, y1 long"), where, 200)
    seen = [(i, x0, x1, y0, y1) for i, x0, x1, y0, y1 in rows if x1 > 2000 and x0 < 6000 and y1 > 2000 and y0 < 6000]
    got = clustered.read_view(spark, where, view)
    assert sorted(map(tuple, got.collect())) == sorted(seen)
    every = len(spark.read.parquet(f"{where}/rows").inputFiles())
    assert len(got.inputFiles()) < every // 2
    for most in (1, 40, 5000):
        top = clustered.nearest_in_view(spark, where, view, most, ["id"])
        want = sorted(((x0 + x1 - 8000) ** 2 + (y0 + y1 - 8000) ** 2, i) for i, x0, x1, y0, y1 in seen)[:most]
        assert [(r["d2"], r["id"]) for r in top.collect()] == want
        assert most > 40 or len(top.inputFiles()) < len(got.inputFiles()) // 2
    assert clustered.read_view(spark, where, (20_000, 20_000, 30_000, 30_000)).count() == 0
