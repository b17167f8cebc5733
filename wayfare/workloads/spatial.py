"""Queries by place: snaps, distance joins, clusters, zones, viewports.

Points derive from the driver's tables; all places are whole microdegrees.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions.geo import haversine_m
from wayfare.operators import spatial
from wayfare.operators.components import components
from wayfare.session import remove_folder, settle, shared_folder
from wayfare.sources import clustered

REACH, SNAP, CLUSTER = 150, 200, 1000
VIEW = (-90_000, 51_505_000, -70_000, 51_530_000)


def _points(spark: SparkSession, sf: str, table: str, key: str, stretch: int) -> DataFrame:
    """id, px, py: rows of a table scattered around the grid's nodes."""
    n = net.nodes(spark, sf).agg(F.count("*").alias("n"), (F.max("gx") + 1).alias("w"))
    rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).alias("id")).crossJoin(F.broadcast(n))
    return rows.select("id", F.expr(f"-100000 + (id * 37 % n) % w * 1000 + id * 7919 % {stretch} - {stretch // 2}").alias("px"), F.expr(f"51500000 + (id * 37 % n) div w * 1000 + id * 104729 % {stretch} - {stretch // 2}").alias("py"))


def collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Collisions that involve a bicycle: orders with a returned item."""
    bikes = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return _points(spark, sf, "orders", "o_orderkey", 600).join(bikes, "id", "left_semi")


def _streets(spark: SparkSession, sf: str) -> DataFrame:
    at = net.nodes(spark, sf).select("node_id", "x_u", "y_u")
    w = net.ways(spark, sf).select("way_id", "u", "v", "type")
    return w.join(at.toDF("u", "ux", "uy"), "u").join(at.toDF("v", "vx", "vy"), "v")


def road_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Collisions within reach of each street: their number, and the number of id batches of 1000 with one."""
    near = spatial.points_near_segments(collisions(spark, sf), _streets(spark, sf), REACH)
    return near.groupBy("way_id").agg(F.count("*").alias("hits"), F.count_distinct(F.expr("id div 1000")).alias("batches"))


def nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    at = net.nodes(spark, sf).select("node_id", F.col("x_u").alias("qx"), F.col("y_u").alias("qy"))
    near = spatial.points_near_points(_points(spark, sf, "customer", "c_custkey", 500), at, SNAP).filter(F.col("d2") < SNAP * SNAP)
    return spatial.nearest(near, "id", ["d2", "node_id"]).select("id", "node_id", "d2")


def nearest_street(spark: SparkSession, sf: str) -> DataFrame:
    near = spatial.points_near_segments(_points(spark, sf, "customer", "c_custkey", 500), _streets(spark, sf), SNAP)
    return spatial.nearest(near, "id", ["d", "way_id"]).select("id", "way_id", F.floor(F.col("d") * 1000 + 0.5).cast("bigint").alias("d_milli"), (F.col("frac") > 0.5).alias("at_end"))


def preferred_street(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest car street, or the nearest cycleway where that is at most 1.15 times as far."""
    near = spatial.points_near_segments(_points(spark, sf, "supplier", "s_suppkey", 500), _streets(spark, sf), SNAP).withColumn("cycle", F.col("type") == "cycleway")
    best = near.groupBy("id").agg(*[F.min(F.when(F.col("cycle") == c, F.struct("d", "way_id"))).alias(k) for k, c in (("cw", True), ("car", False))])
    take = F.when(F.col("car").isNull() | (F.col("cw.d") <= F.col("car.d") * 1.15), F.col("cw")).otherwise(F.col("car"))
    return best.select("id", take["way_id"].alias("way_id"))


#: Radii of the snap in microdegrees; farther than the limit in metres there is none.
RADII, SNAP_LIMIT_M = (450, 1000, 10_300), 1000


def widening_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest street by growing radius, only points without one going on to the next; the nearer end is the anchor."""
    at = net.nodes(spark, sf).select("node_id", "x_u", "y_u")
    streets = net.ways(spark, sf).select("way_id", "u", "v").join(at.toDF("u", "ux", "uy"), "u").join(at.toDF("v", "vx", "vy"), "v")
    left, out = _points(spark, sf, "customer", "c_custkey", 9000), None
    for radius in RADII:
        near = spatial.points_near_segments(left, streets, radius)
        foot = [(F.col("ux") + F.col("frac") * (F.col("vx") - F.col("ux"))) / 1e6, (F.col("uy") + F.col("frac") * (F.col("vy") - F.col("uy"))) / 1e6]
        near = near.withColumn("metres", haversine_m(F.col("px") / 1e6, F.col("py") / 1e6, *foot))
        hit = near.groupBy("id").agg(F.min(F.struct("d", "way_id", F.when(F.col("frac") <= 0.5, F.col("u")).otherwise(F.col("v")).alias("anchor"), "metres")).alias("x"))
        hit = settle(hit.select("id", "x.way_id", "x.anchor", F.lit(radius).alias("radius"), "x.metres"))
        left = settle(left.join(hit, "id", "left_anti"))
        out = hit if out is None else out.unionByName(hit)
    return out.filter(F.col("metres") <= SNAP_LIMIT_M).select("id", "way_id", "anchor", "radius")


def junction_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Junctions with signals at most a cell apart form clusters; the highest node stands for each."""
    j = net.nodes(spark, sf).filter("signals = 'yes'").select("node_id", "x_u", "y_u", "elev_cm")
    other = j.select(F.col("node_id").alias("o"), F.col("x_u").alias("qx"), F.col("y_u").alias("qy"))
    pairs = spatial.points_near_points(j, other, CLUSTER, "x_u", "y_u").filter("node_id < o").select("node_id", "o")
    label = components(pairs, "node_id", "o").withColumnRenamed("node", "node_id")
    rows = j.join(label, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    top = rows.groupBy("component").agg(F.max_by("node_id", F.struct("elev_cm", -F.col("node_id"))).alias("top"))  # combines before the shuffle
    return rows.join(top, "component").select("node_id", "component", (F.col("node_id") != F.col("top")).alias("suppressed"))


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("bigint").alias("zone"), F.expr("-100000 + n_nationkey % 5 * 8000L").alias("x0"), F.expr("-100000 + n_nationkey % 5 * 8000L + 9500").alias("x1"), F.expr("51500000 + n_nationkey div 5 * 8000").alias("y0"), F.expr("51500000 + n_nationkey div 5 * 8000 + 9500").alias("y1"))


def zone_owner(spark: SparkSession, sf: str) -> DataFrame:
    """The zone that holds the most of a street, at least half of it; the later zone among equals."""
    s = _streets(spark, sf)
    box = spatial.segment_in_box_share(*[F.col(c) for c in ("ux", "uy", "vx", "vy", "x0", "x1", "y0", "y1")])
    cells = s.withColumn("_c", spatial.box_cells(F.least("ux", "vx"), F.greatest("ux", "vx"), F.least("uy", "vy"), F.greatest("uy", "vy"), 8000)).select("*", "_c.cx", "_c.cy")
    zones = _zones(spark, sf).withColumn("_c", spatial.box_cells(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), 8000)).select("zone", "x0", "x1", "y0", "y1", "_c.cx", "_c.cy")
    over = spatial.meet_in_cells(cells, zones).withColumn("milli", F.floor(box * 1000 + 0.5).cast("bigint")).filter("milli >= 500")
    return over.groupBy("way_id").agg(F.max(F.struct("milli", "zone")).alias("x")).select("way_id", "x.zone", "x.milli")


def viewport(spark: SparkSession, sf: str, most: int = 20_000) -> DataFrame:
    """The streets nearest to the centre among those that overlap the view, with the number of all."""
    x0, y0, x1, y1 = VIEW
    s = _streets(spark, sf).filter((F.greatest("ux", "vx") > x0) & (F.least("ux", "vx") < x1) & (F.greatest("uy", "vy") > y0) & (F.least("uy", "vy") < y1))
    mid = lambda a, b, c: (F.col(a) + F.col(b) - c) * (F.col(a) + F.col(b) - c)
    total = s.agg(F.count("*").alias("found"))
    top = s.withColumn("d2", mid("ux", "vx", x0 + x1) + mid("uy", "vy", y0 + y1)).orderBy("d2", "way_id").limit(most)
    return top.crossJoin(F.broadcast(total)).select("way_id", "d2", "found")


def clustered_view(spark: SparkSession, sf: str, most: int = 500) -> DataFrame:
    """The viewport's nearest streets from streets stored along a Hilbert curve: only files near enough are read."""
    where = f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    boxes = _streets(spark, sf).select("way_id", *[f(f"u{q}", f"v{q}").alias(f"{q}{i}") for q in "xy" for i, f in enumerate((F.least, F.greatest))])
    clustered.write(boxes, where, files=64)
    out = settle(clustered.nearest_in_view(spark, where, VIEW, most, ["way_id"]).select("way_id", "d2"))
    remove_folder(spark, where)
    return out


def points_in_view(spark: SparkSession, sf: str) -> DataFrame:
    x0, y0, x1, y1 = VIEW
    return _points(spark, sf, "customer", "c_custkey", 500).filter(F.col("px").between(x0, x1) & F.col("py").between(y0, y1))


QUERIES = {"f02_bike_collisions": collisions, "j05_road_risk": road_risk, "j07_nearest_node": nearest_node, "j08_nearest_street": nearest_street, "j10_preferred_street": preferred_street, "j16_widening_snap": widening_snap, "g04_junction_clusters": junction_clusters, "j14_zone_owner": zone_owner, "t01_viewport": viewport, "t01_clustered_view": clustered_view, "f11_points_in_view": points_in_view}


def _pts(name: str, table: str, key: str, stretch: int, where: str = "") -> str:
    return f", {name} AS (SELECT {key} AS id, -100000 + ({key} * 37 % n) % w * 1000 + {key} * 7919 % {stretch} - {stretch // 2} AS px, 51500000 + ({key} * 37 % n) // w * 1000 + {key} * 104729 % {stretch} - {stretch // 2} AS py FROM {table}, grid {where})"


_STREETS = ", streets AS (SELECT way_id, type, a.x_u AS ux, a.y_u AS uy, b.x_u AS vx, b.y_u AS vy FROM ways s JOIN nodes a ON a.node_id = s.u JOIN nodes b ON b.node_id = s.v)"
#: All streets run along an axis, so a point's distance is to the nearest place on that side.
_D = "sqrt(((px - greatest(ux, least(vx, px))) ** 2 + (py - greatest(uy, least(vy, py))) ** 2)::DOUBLE)"
_FRAC = "greatest(0, least(1, CASE WHEN ux = vx THEN (py - uy) / (vy - uy)::DOUBLE ELSE (px - ux) / (vx - ux)::DOUBLE END))"
_C500 = net.SQL + _pts("pts", "customer", "c_custkey", 500) + _STREETS


def _near(reach: int) -> str:
    return f"SELECT id, way_id, type, {_D} AS d, {_FRAC} AS frac FROM pts JOIN streets ON px BETWEEN ux - {reach} AND vx + {reach} AND py BETWEEN uy - {reach} AND vy + {reach} WHERE {_D} <= {reach}"


_BIKES = "WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
ORACLE_SQL = {
    "f02_bike_collisions": net.SQL + _pts("pts", "orders", "o_orderkey", 600, _BIKES) + " SELECT * FROM pts",
    "j05_road_risk": net.SQL + _pts("pts", "orders", "o_orderkey", 600, _BIKES) + _STREETS + f" SELECT way_id, count(*) AS hits, count(DISTINCT id // 1000) AS batches FROM ({_near(REACH)}) GROUP BY 1",
    "j07_nearest_node": net.SQL + _pts("pts", "customer", "c_custkey", 500) + f" SELECT id, node_id, d2 FROM (SELECT id, node_id, (px - x_u) * (px - x_u) + (py - y_u) * (py - y_u) AS d2 FROM pts, nodes WHERE abs(px - x_u) < {SNAP} AND abs(py - y_u) < {SNAP}) WHERE d2 < {SNAP * SNAP} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, node_id) = 1",
    "j08_nearest_street": _C500 + f" SELECT id, way_id, cast(floor(d * 1000 + 0.5) AS BIGINT) AS d_milli, frac > 0.5 AS at_end FROM ({_near(SNAP)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, way_id) = 1",
    "j10_preferred_street": net.SQL + _pts("pts", "supplier", "s_suppkey", 500) + _STREETS + f", near AS ({_near(SNAP)}), best AS (SELECT id, min((d, way_id)) FILTER (WHERE type = 'cycleway') AS cw, min((d, way_id)) FILTER (WHERE type <> 'cycleway') AS car FROM near GROUP BY 1) SELECT id, CASE WHEN car IS NULL OR cw[1] <= car[1] * 1.15::DOUBLE THEN cw[2] ELSE car[2] END AS way_id FROM best",
    "j16_widening_snap": net.SQL + _pts("pts", "customer", "c_custkey", 9000) + _STREETS + f", best AS (SELECT id, way_id, d, frac FROM ({_near(10300)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, way_id) = 1), foot AS (SELECT id, way_id, d, frac, px, py, greatest(ux, least(vx, px)) AS fx, greatest(uy, least(vy, py)) AS fy FROM best JOIN pts USING (id) JOIN streets USING (way_id)) SELECT id, way_id, CASE WHEN frac <= 0.5 THEN u ELSE v END AS anchor, CASE WHEN d <= 450 THEN 450 WHEN d <= 1000 THEN 1000 ELSE 10300 END AS radius FROM foot JOIN ways USING (way_id) WHERE 2 * 6371000::DOUBLE * asin(sqrt(sin(radians((fy - py) / 1e6::DOUBLE) / 2) ** 2 + cos(radians(py / 1e6::DOUBLE)) * cos(radians(fy / 1e6::DOUBLE)) * sin(radians((fx - px) / 1e6::DOUBLE) / 2) ** 2)) <= 1000",
    "g04_junction_clusters": net.SQL.replace("WITH grid", "WITH RECURSIVE grid", 1) + f", j AS (SELECT t.node_id, t.elev_cm, n.x_u, n.y_u FROM tagged_nodes t JOIN nodes n USING (node_id) WHERE signals = 'yes'), pairs AS (SELECT a.node_id AS a, b.node_id AS b FROM j a, j b WHERE abs(a.x_u - b.x_u) + abs(a.y_u - b.y_u) <= {CLUSTER}), reach AS (SELECT a, a AS b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b), label AS (SELECT b AS node_id, min(a) AS component FROM reach GROUP BY 1) SELECT node_id, component, row_number() OVER (PARTITION BY component ORDER BY elev_cm DESC, node_id) > 1 AS suppressed FROM j JOIN label USING (node_id)",
    "j14_zone_owner": net.SQL + _STREETS + ", zones AS (SELECT n_nationkey::BIGINT AS zone, -100000 + n_nationkey % 5 * 8000 AS x0, 51500000 + n_nationkey // 5 * 8000 AS y0 FROM nation), over AS (SELECT way_id, zone, cast(floor(greatest(0, CASE WHEN ux = vx THEN (least(vy, y0 + 9500) - greatest(uy, y0)) / (vy - uy)::DOUBLE ELSE (least(vx, x0 + 9500) - greatest(ux, x0)) / (vx - ux)::DOUBLE END) * 1000 + 0.5) AS BIGINT) AS milli FROM streets, zones WHERE vx >= x0 AND ux <= x0 + 9500 AND vy >= y0 AND uy <= y0 + 9500) SELECT * FROM over WHERE milli >= 500 QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY milli DESC, zone DESC) = 1",
    "t01_viewport": net.SQL + _STREETS + f", seen AS (SELECT * FROM streets WHERE vx > {VIEW[0]} AND ux < {VIEW[2]} AND vy > {VIEW[1]} AND uy < {VIEW[3]}) SELECT way_id, (ux + vx - {VIEW[0] + VIEW[2]}) ** 2 + (uy + vy - {VIEW[1] + VIEW[3]}) ** 2 AS d2, (SELECT count(*) FROM seen) AS found FROM seen ORDER BY d2, way_id LIMIT 20000",
    "t01_clustered_view": net.SQL + _STREETS + f" SELECT way_id, (ux + vx - {VIEW[0] + VIEW[2]}) * (ux + vx - {VIEW[0] + VIEW[2]}) + (uy + vy - {VIEW[1] + VIEW[3]}) * (uy + vy - {VIEW[1] + VIEW[3]}) AS d2 FROM streets WHERE vx > {VIEW[0]} AND ux < {VIEW[2]} AND vy > {VIEW[1]} AND uy < {VIEW[3]} ORDER BY d2, way_id LIMIT 500",
    "f11_points_in_view": net.SQL + _pts("pts", "customer", "c_custkey", 500) + f" SELECT * FROM pts WHERE px BETWEEN {VIEW[0]} AND {VIEW[2]} AND py BETWEEN {VIEW[1]} AND {VIEW[3]}",
}
