"""Shapefiles: round trips in several partitions, pushed boxes, bytes of the format by hand."""

import glob
import random
import struct

from pyspark.sql import functions as F

from wayfare.sources import shapefile

SCHEMA = "osm_id long, fclass string, speed double, bridge boolean, parts array<array<struct<x double, y double>>>"


def test_round_trip(spark, tmp_path):
    """Several parts, long lines, null and empty attributes, letters beyond ASCII, shapes without a place."""
    r = random.Random(4)
    line = lambda n: [(r.uniform(-1, 1), r.uniform(50, 52)) for _ in range(n)]
    rows = [(i, r.choice(["primary", "Straße", None, "x" * 200]), r.choice([None, -1.5e-7, 1 / 3, 1e300]), r.choice([None, True, False]), r.choice([[line(2)], [line(3), line(5)], [line(4000)], None])) for i in range(300)] + [(None, None, None, None, None)]
    where = str(tmp_path / "s")
    shapefile.write(spark.createDataFrame(rows, SCHEMA).repartition(3), where, records=40)
    got = shapefile.read(spark, where, ["osm_id", "fclass", "ref", "speed", "bridge"], records=17)
    assert got.columns == ["osm_id", "fclass", "speed", "bridge", "xmin", "xmax", "ymin", "ymax", "parts"]
    assert got.rdd.getNumPartitions() > 9
    flat = lambda t: repr(t)
    seen = [(a, b, c, d, None if p is None else [[(q["x"], q["y"]) for q in part] for part in p]) for a, b, c, d, p in got.select("osm_id", "fclass", "speed", "bridge", "parts").collect()]
    assert sorted(seen, key=flat) == sorted(rows, key=flat)


def test_box_skips_files_and_shapes(spark, tmp_path):
    rows = [(i, "a", 1.0, True, [[(float(i), 0.0), (i + 0.5, 1.0)]]) for i in range(200)]
    where = str(tmp_path / "s")
    shapefile.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), where, records=20)
    got = shapefile.read(spark, where).filter((F.col("xmax") >= 30.5) & (F.col("xmin") < 45) & (F.col("osm_id") != 33))
    assert sorted(r["osm_id"] for r in got.select("osm_id").collect()) == [i for i in range(30, 45) if i != 33]
    assert got.select("osm_id").rdd.getNumPartitions() == 2
    assert shapefile.read(spark, where).filter("xmin > 1000").count() == 0


def test_bytes_of_the_format(spark, tmp_path):
    """What is written has the lengths and offsets that the format asks for; what is put together by hand is read: points, deleted rows."""
    where = str(tmp_path / "s")
    shapefile.write(spark.createDataFrame([(1, "a", 1.0, True, [[(0.0, 0.0), (2.0, 3.0)]]), (2, "bc", 2.0, None, None)], SCHEMA).coalesce(1), where, "polygon")
    shp, shx, dbf = (open(glob.glob(f"{where}/*.{e}")[0], "rb").read() for e in ("shp", "shx", "dbf"))
    assert struct.unpack_from(">i", shp, 24)[0] * 2 == len(shp) and struct.unpack_from(">i", shx, 24)[0] * 2 == len(shx)
    assert struct.unpack_from("<i", shp, 32)[0] == 5 and struct.unpack_from("<4d", shp, 36) == (0, 0, 2, 3)
    (first, n), (second, m) = (struct.unpack_from(">2i", shx, 100 + 8 * i) for i in range(2))
    assert first == 50 and second == first + 4 + n and second * 2 + 8 + m * 2 == len(shp)
    rows, size, width = struct.unpack_from("<IHH", dbf, 4)
    assert rows == 2 and len(dbf) == size + 2 * width + 1

    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, 1, 1, 2, 5, 6, 0, 0, 0, 0)
    dots = b"".join(struct.pack(">2i", i, 10) + struct.pack("<i2d", 1, x, y) for i, (x, y) in enumerate([(1, 2), (5, 6)], 1))
    (tmp_path / "p.shp").write_bytes(head(100 + len(dots)) + dots)
    (tmp_path / "p.shx").write_bytes(head(116) + struct.pack(">4i", 50, 10, 64, 10))
    (tmp_path / "p.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 100, 1, 1, 2, 65, 5) + struct.pack("<11sc4xBB14x", b"CODE", b"N", 4, 0) + b"\r" + b"*  12" + b"   7" + b" ")
    got = shapefile.read(spark, str(tmp_path / "p.shp")).collect()
    assert len(got) == 1 and got[0]["xmin"] == 5 and got[0]["parts"][0][0]["y"] == 6
