"""Queries over heights and shapes: rasters, grades, smoothing, polylines and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions import geo
from wayfare.functions import tags as t
from wayfare.operators import runs
from wayfare.operators.components import components
from wayfare.operators.expansion import expand
from wayfare.session import settle
from wayfare.workloads import paths
from wayfare.workloads import shapes as shapes_of
from wayfare.workloads import spatial as sp

#: A raster cell in microdegrees; cells are the grid's nodes. Values at or under the limit mean that there are none.
CELL, NO_DATA = 1000, -1000
#: Metres under which a steep edge on its own is noise, and what stays of it.
DAMPING = ((12, 0.0), (20, 0.3), (35, 0.5))
GRADE_CAP, STEEP = 0.2, 0.04
#: Millimetres: the summit window, and the window of the road mean, which is also how far off a bridge its anchors lie.
SUMMIT_M, WINDOW_MM = 150_000, 30_000


def milli(c, scale: float = 1000.0):
    return F.floor(c * scale + 0.5).cast("bigint")


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """row, col, val: a height in centimetres for each node; one cell in 17 has no data."""
    return net.nodes(spark, sf).select(F.col("gy").alias("row"), F.col("gx").alias("col"), F.expr("if(node_id % 17 = 0, -9999, elev_cm)").alias("val"))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    p = sp._points(spark, sf, "customer", "c_custkey", 500)
    return p.select("id", "px", "py", F.expr(f"floor((py - 51500000) / {CELL})").alias("row"), F.expr(f"floor((px + 100000) / {CELL})").alias("col"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The raster's value at each place; 0 where it has none."""
    return _places(spark, sf).join(raster(spark, sf), ["row", "col"], "left").select("id", F.when(F.col("val") > NO_DATA, F.col("val")).otherwise(0).alias("cm"))


def _patch(spark: SparkSession, sf: str, reach: int) -> DataFrame:
    """Each place with the cells of the square around it, reach cells each way, that have data."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    around = _places(spark, sf).withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    around = around.withColumns({"row": F.col("row") + F.col("dr"), "col": F.col("col") + F.col("dc")})
    return around.join(raster(spark, sf).filter(F.col("val") > NO_DATA), ["row", "col"])


def weighted_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights by inverse squared distance over the nine cells around a place, to their middles."""
    p = _patch(spark, sf, 1)
    d2 = F.pow((F.col("px") + 100000 - F.col("col") * CELL - CELL // 2).cast("double"), F.lit(2)) + F.pow((F.col("py") - 51500000 - F.col("row") * CELL - CELL // 2).cast("double"), F.lit(2))
    p = p.withColumn("w", F.when(d2 == 0, 1e12).otherwise(1e6 / d2))
    return p.groupBy("id").agg(milli(F.sum(F.col("w") * F.col("val")) / F.sum("w"), 10.0).alias("mm"))


def median_heights(spark: SparkSession, sf: str) -> DataFrame:
    """The median of the 25 cells around a place."""
    return _patch(spark, sf, 2).groupBy("id").agg(milli(F.percentile("val", 0.5), 10.0).alias("mm"), F.count("*").alias("cells"))


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Short test edges: grade as rise over length (0 for the shortest), then 0 under 5 m and on footways, then capped."""
    e = _short(spark, sf)
    raw = F.when(F.col("mm") <= 100, 0.0).otherwise(F.col("rise_cm") * 10e0 / F.col("mm"))
    flat = F.when((F.col("mm") < 5000) | F.col("type").isin("footway", "pedestrian", "steps"), 0.0).otherwise(raw)
    cap = lambda x, limit: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    return e.select("u", "v", milli(cap(raw, 0.3), 10000.0).alias("legacy"), milli(cap(flat, GRADE_CAP), 10000.0).alias("grade"))


def _short(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges with lengths of 0 to 60 metres, so that every rule on short edges has cases."""
    return net.edges(spark, sf).select("u", "v", "type", F.expr("length_mm * 31 % 60000").alias("mm"), F.expr("rise_cm div 40").alias("rise_cm"))


def damped(spark: SparkSession, sf: str) -> DataFrame:
    """A steep short edge is damped by its length unless another steep edge meets it at either end."""
    e = _short(spark, sf).withColumn("grade", F.when(F.col("mm") <= 100, 0.0).otherwise(F.col("rise_cm") * 10e0 / F.col("mm")))
    # how many steep edges, of any length, meet at a node; an edge and its way back count as one
    pair = e.filter(F.abs("grade") > STEEP).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    degree = pair.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    out = e.join(degree.toDF("u", "nu"), "u", "left").join(degree.toDF("v", "nv"), "v", "left")
    alone = (F.coalesce("nu", F.lit(0)) <= 1) & (F.coalesce("nv", F.lit(0)) <= 1)
    factor = F.lit(1.0)
    for limit, keep in reversed(DAMPING):
        factor = F.when(F.col("mm") < limit * 1000, keep).otherwise(factor)
    grade = F.when((F.abs("grade") > STEEP) & alone, F.col("grade") * factor).otherwise(F.col("grade"))
    return out.select("u", "v", milli(F.greatest(F.lit(-GRADE_CAP), F.least(F.lit(GRADE_CAP), grade)), 10000.0).alias("grade"))


def rivers(spark: SparkSession, sf: str, passes: int = 5) -> DataFrame:
    """Heights along river streets after at most five passes in which no node may lie above one that flows into it."""
    flow = settle(net.ways(spark, sf).filter(t.yes("is_river")).select("u", "v"))
    h = settle(net.nodes(spark, sf).select("node_id", "elev_cm"))
    for _ in range(passes):
        low = flow.join(h, flow.u == h.node_id).groupBy("v").agg(F.min("elev_cm").alias("low")).withColumnRenamed("v", "node_id")
        h = settle(h.join(low, "node_id", "left").select("node_id", F.least("elev_cm", "low").alias("elev_cm")))
    return h


def _around(spark: SparkSession, sf: str, links: DataFrame, limit: int) -> DataFrame:
    """Each node's mean height with the nodes that links reach within limit."""
    own = net.nodes(spark, sf).select("node_id", "elev_cm")
    reach = expand(links, own.select(F.col("node_id").alias("source"), F.col("node_id").alias("node")), limit)
    return reach.join(own, F.col("node") == F.col("node_id")).groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("n"), F.expr("sum(elev_cm) * 10 div count(*)").alias("mm"))


def smoothed(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's mean height with the nodes that its streets reach within 150 m."""
    return _around(spark, sf, net.edges(spark, sf).select("u", "v", F.col("length_mm").alias("cost")), SUMMIT_M)


#: Length in millimetres of streets of 1 to 60 metres, every third of at most 6, so that a window holds many of them in a row.
SHORT_MM = "if(way_id % 3 = 0, 1000 + k * 977 % 5000, 5000 + k * 3571 % 55000)"


def road_window(spark: SparkSession, sf: str) -> DataFrame:
    """Mean heights over a window of 30 m: all nodes within 15 m along short streets, over any number of them."""
    return _around(spark, sf, net.edges(spark, sf).select("u", "v", F.expr(SHORT_MM).alias("cost")), WINDOW_MM // 2)


def _runs_of_bridges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Streets on bridges (runs of one kind of street along a row), and their nodes with the run's least node."""
    w = net.ways(spark, sf).filter("way_id % 2 = 0 AND k % 5 < 2").select("u", "v")
    return w, components(w, "u", "v").withColumnRenamed("node", "node_id")


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Heights on bridges between anchors: from each of a run's two ends the nearest node 30 m or more away along short streets off the run.

    A node's height is by its share of the way between the anchors on the sphere, 0 to 1; without an anchor the end
    itself is one. Runs with other than two ends, or with both anchors at one place, keep their heights.
    """
    bridges, label = _runs_of_bridges(spark, sf)
    label = settle(label)
    degree = bridges.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    ends = label.join(degree.filter("n = 1"), "node_id").groupBy("component").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"), F.count("*").alias("n")).filter("n = 2")
    ends = ends.select("component", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("node")) for i, c in enumerate("ab")])).alias("e")).select("component", "e.*")
    w = net.ways(spark, sf).select("u", "v", F.expr(SHORT_MM).alias("cost"))
    links = w.unionByName(w.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost"))
    # a node is one run's at most, so it names its source
    sources = ends.select(F.col("node").alias("source"), "node")
    barred = ends.select("component", F.col("node").alias("source")).join(label, "component").select("source", F.col("node_id").alias("node"))
    far = expand(links, sources, WINDOW_MM, past=True, barred=barred).filter(F.col("dist") >= WINDOW_MM)
    found = far.groupBy(F.col("source").alias("node")).agg(F.min(F.struct("dist", F.col("node").alias("to"))).alias("hit"))
    at = net.nodes(spark, sf).select("node_id", "x_u", "y_u", "elev_cm")
    anchor = ends.join(found, "node", "left").withColumn("anchor", F.coalesce("hit.to", "node")).join(at.toDF("anchor", "x", "y", "h"), "anchor")
    pair = anchor.groupBy("component").agg(*[F.max(F.when(F.col("side") == i, F.struct("anchor", "x", "y", "h"))).alias(c) for i, c in enumerate("ab")])
    span = lambda p, q: geo.haversine_m(*[c / 1e6 for c in (*p, *q)])
    a, b, own = (F.col("a.x"), F.col("a.y")), (F.col("b.x"), F.col("b.y")), (F.col("x_u"), F.col("y_u"))
    out = label.join(at, "node_id").join(pair, "component").withColumn("total", span(a, b))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), span(a, own) / F.col("total")))
    height = F.when(F.col("total") == 0, F.col("elev_cm").cast("double")).otherwise(F.col("a.h") + (F.col("b.h") - F.col("a.h")) * share)
    return out.select("node_id", "component", F.col("a.anchor").alias("anchor_a"), F.col("b.anchor").alias("anchor_b"), milli(height, 10.0).alias("mm"))


def bridged(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of bridges: heights between those of the two ends, by distance."""
    _, label = _runs_of_bridges(spark, sf)
    at = label.join(net.nodes(spark, sf).select("node_id", "x_u", "elev_cm"), "node_id")
    ends = at.groupBy("component").agg(F.min(F.struct("x_u", "elev_cm")).alias("a"), F.max(F.struct("x_u", "elev_cm")).alias("b"))
    out = at.join(ends, "component").withColumn("f", (F.col("x_u") - F.col("a.x_u")) / (F.col("b.x_u") - F.col("a.x_u")))
    return out.select("node_id", "component", milli(F.col("a.elev_cm") + (F.col("b.elev_cm") - F.col("a.elev_cm")) * F.col("f"), 10.0).alias("mm"))


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """Length on the sphere, direction, and angle to the line across, of each street; barrier confidence at a distance from it."""
    at = net.nodes(spark, sf).select("node_id", "x_u", "y_u")
    s = net.ways(spark, sf).select("way_id", "u", "v").join(at.toDF("u", "ux", "uy"), "u").join(at.toDF("v", "vx", "vy"), "v")
    metres = geo.haversine_m(F.col("ux") / 1e6, F.col("uy") / 1e6, F.col("vx") / 1e6, F.col("vy") / 1e6)
    angle = geo.angle_deg((F.col("vx") - F.col("ux")).cast("double"), (F.col("vy") - F.col("uy")).cast("double"), (F.col("way_id") % 7 - 3).cast("double"), (F.col("way_id") % 5 - 2).cast("double"))
    return s.select("way_id", milli(metres).alias("mm"), milli(angle).alias("angle_milli"), milli(geo.barrier_confidence((F.col("way_id") % 60).cast("double"), 1.0 + F.col("way_id") % 12 / 100.0)).alias("confidence_milli"))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Places in metres of the spherical Mercator projection, and back."""
    x, y = geo.mercator(F.col("x_u") / 1e6, F.col("y_u") / 1e6)
    lon, lat = geo.from_mercator(x, y)
    return net.nodes(spark, sf).select("node_id", milli(x, 10.0).alias("x_dm"), milli(y, 10.0).alias("y_dm"), milli(lon, 1e6).alias("lon_u"), milli(lat, 1e6).alias("lat_u"))


def british_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Places in decimetres of the British national grid, over the datum shift, and back in microdegrees."""
    p = net.nodes(spark, sf).select("node_id", geo.shift_datum(F.col("x_u") / 1e6, F.col("y_u") / 1e6).alias("b"))
    p = p.select("node_id", geo.to_grid(F.col("b.lon"), F.col("b.lat")).alias("g"))
    p = p.withColumn("b", geo.from_grid(F.col("g.east"), F.col("g.north"))).withColumn("w", geo.shift_datum(F.col("b.lon"), F.col("b.lat"), False))
    return p.select("node_id", milli(F.col("g.east"), 10.0).alias("east_dm"), milli(F.col("g.north"), 10.0).alias("north_dm"), milli(F.col("w.lon"), 1e6).alias("lon_u"), milli(F.col("w.lat"), 1e6).alias("lat_u"))


def ellipsoid_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of the bent streets on the ellipsoid and on the sphere, in millimetres."""
    ends = [F.col(c) / 1e6 for c in ("ux", "uy", "vx", "vy")]
    return shapes_of.bent_streets(spark, sf).select("way_id", milli(geo.geodesic_m(*ends)).alias("geodesic_mm"), milli(geo.haversine_m(*ends)).alias("sphere_mm"))


def _polylines(spark: SparkSession, sf: str) -> DataFrame:
    """A polyline for each row of the grid, every second one from its far end."""
    n = net.nodes(spark, sf).filter("gx < 12").select("gy", F.struct(F.when(F.col("gy") % 2 == 0, F.col("gx")).otherwise(-F.col("gx")).alias("o"), F.col("y_u").alias("lat"), F.col("x_u").alias("lon")).alias("p"))
    return n.groupBy(F.col("gy").alias("line")).agg(F.sort_array(F.collect_list("p")).alias("p"))


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Polylines turned to start at their western node: bounds, middle, first point as (lon, lat) and as GeoJSON."""
    p = _polylines(spark, sf)
    d2 = lambda q: (q["lon"] + 100000) * (q["lon"] + 100000)
    turned = F.when(d2(F.element_at("p", -1)) < d2(F.element_at("p", 1)), F.reverse("p")).otherwise(F.col("p"))
    p = p.select("line", turned.alias("p"))
    n = F.size("p")
    mid = F.expr("size(p) div 2")
    half = lambda c: F.when(n % 2 == 0, (F.get("p", mid - 1)[c] + F.get("p", mid)[c]) / 2.0).otherwise(F.get("p", mid)[c])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array(*[F.array(F.element_at("p", i)["lon"], F.element_at("p", i)["lat"]) for i in (1, -1)]).alias("coordinates")).alias("geometry"), F.struct(F.col("line").alias("id")).alias("properties")))
    return p.select("line", F.array_min("p.lat").alias("south"), F.array_max("p.lat").alias("north"), F.array_min("p.lon").alias("west"), F.array_max("p.lon").alias("east"), milli(half("lat"), 10.0).alias("mid_lat"), milli(half("lon"), 10.0).alias("mid_lon"), F.element_at("p", 1)["lon"].alias("first_lon"), feature.alias("feature"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """The place at a fixed set of distances along each row: the step that reaches it, and how far into it."""
    p = runs.running(paths.tracks(spark, sf), "path_id", "seq", "length_mm", "end_mm").withColumn("start_mm", F.col("end_mm") - F.col("length_mm"))
    total = p.groupBy("path_id").agg(F.max("end_mm").alias("total"))
    want = total.select("path_id", F.explode(F.expr("sequence(0, 10)")).alias("tenth"), "total").withColumn("d", F.expr("total * tenth div 10"))
    hit = want.join(p, "path_id").filter("d > start_mm AND d <= end_mm OR d = 0 AND start_mm = 0")
    return hit.select("path_id", "tenth", "seq", milli((F.col("d") - F.col("start_mm")) / F.col("length_mm"), 1e6).alias("ppm"))


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Green runs as slices of a row's length: runs of a kind less than half a least width apart merge, short ones widen around their middle."""
    p = runs.running(paths.tracks(spark, sf), "path_id", "seq", "length_mm", "end_mm").withColumn("start_mm", F.col("end_mm") - F.col("length_mm"))
    total = p.groupBy("path_id").agg(F.max("end_mm").alias("total"))
    # 1.5 % of the row, 40 m at least, times ten so that short rows have cases
    p = p.join(total, "path_id").withColumn("least", F.expr("greatest(400000, total * 15 div 100)"))
    g = p.filter(t.yes("is_park") | t.yes("is_river")).withColumn("kind", F.when(t.yes("is_park"), "park").otherwise("river"))
    w = Window.partitionBy("path_id").orderBy("seq")
    new = F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | ((F.col("start_mm") - F.lag("end_mm").over(w)) * 2 >= F.col("least"))
    g = g.withColumn("_n", new.cast("int")).withColumn("slice", F.sum("_n").over(w) - 1)
    s = g.groupBy("path_id", "slice").agg(F.first("kind").alias("kind"), F.min("start_mm").alias("d0"), F.max("end_mm").alias("d1"), F.max("least").alias("least"), F.max("total").alias("total"))
    narrow, mid = F.col("d1") - F.col("d0") < F.col("least"), F.expr("(d0 + d1) div 2")
    half = F.expr("least div 2")
    return s.select("path_id", "slice", "kind", F.when(narrow, F.greatest(F.lit(0), mid - half)).otherwise(F.col("d0")).alias("d0"), F.when(narrow, F.least("total", mid + half)).otherwise(F.col("d1")).alias("d1"))


def typed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each row by light, by hills and by cycle infrastructure, in one table."""
    rows = paths.tracks(spark, sf)
    grade = F.expr("(lead(elev_cm) OVER (PARTITION BY path_id ORDER BY seq) - elev_cm) * 10e0 / length_mm")
    rows = rows.withColumn("g", F.coalesce(grade, F.lit(0.0)))
    cluster = t.cycleway_cluster()
    cycle = F.when(cluster == 1, "segregated").when(cluster == 2, "bus_shared").when(cluster == 3, "car_shared").when(t.vehicular_free(), "segregated").when(F.col("programme") != "", "network")
    light = rows.withColumns({"family": F.lit("light"), "kind": F.when(t.is_lit(), "lit").otherwise("unlit")})
    hill = rows.filter((F.col("g") > t.UP) | (F.col("g") < t.DOWN)).withColumns({"family": F.lit("hill"), "kind": F.lit("steep")})
    road = rows.withColumns({"family": F.lit("cycle"), "kind": cycle}).filter("kind IS NOT NULL")
    pool = light.unionByName(hill).unionByName(road).withColumn("key", F.struct("family", "path_id"))
    return runs.collapse_runs(pool, "key", "seq", "kind", ["length_mm"]).select("key.family", "key.path_id", "run", "first_seq", "last_seq", "kind", "length_mm")


QUERIES = {
    "s16_samples": samples, "x08_weighted_heights": weighted_heights, "x09_median_heights": median_heights, "x10_grades": graded, "x11_damped_grades": damped, "g14_rivers": rivers,
    "g15_smoothed": smoothed, "g15_road_window": road_window, "g13_anchored_bridges": anchored, "x05_british_grid": british_grid, "x07_ellipsoid_lengths": ellipsoid_lengths, "g13_bridges": bridged, "x01_measures": measures, "x05_projected": projected, "x45_shapes": shapes, "w12_positions": positions, "w13_slices": slices, "w05_typed_runs": typed_runs,
}

_m = lambda x, s=1000: f"cast(floor(({x}) * {s} + 0.5) AS BIGINT)"
_PLACES = net.SQL + sp._pts("pts", "customer", "c_custkey", 500) + ", cells AS (SELECT gy AS r, gx AS c, elev_cm AS val, node_id FROM nodes), at AS (SELECT id, px, py, cast(floor((py - 51500000) / 1000) AS BIGINT) AS r, cast(floor((px + 100000) / 1000) AS BIGINT) AS c FROM pts)"
_PLACES = _PLACES.replace(", at AS", ", spot AS")
_SHORT = net.SQL + ", e AS (SELECT u, v, type, length_mm * 31 % 60000 AS mm, CASE WHEN rise_cm < 0 THEN -((-rise_cm) // 40) ELSE rise_cm // 40 END AS rise FROM edges), g AS (SELECT *, CASE WHEN mm <= 100 THEN 0 ELSE rise * 10::DOUBLE / mm END AS grade FROM e)"
_RUN = paths._TRACKS + ", run AS (SELECT *, end_mm - length_mm AS start_mm, max(end_mm) OVER (PARTITION BY path_id) AS total FROM (SELECT *, sum(length_mm) OVER (PARTITION BY path_id ORDER BY seq)::BIGINT AS end_mm FROM tracks))"


def _clip(x: str, limit: float) -> str:
    return f"greatest(-{limit}::DOUBLE, least({limit}::DOUBLE, {x}))"


def _typed_sql() -> str:
    from wayfare.workloads import network as n

    cluster = "least(CASE WHEN type = 'cycleway' THEN 1 END, " + ", ".join("CASE " + " ".join(f"WHEN {c} IN {n._in(v)} THEN {k}" for k, v in t.CYCLEWAYS.items()) + " END" for c in ("cycleway", "cycleway_left")) + ")"
    rows = f"rws AS (SELECT *, coalesce((lead(elev_cm) OVER (PARTITION BY path_id ORDER BY seq) - elev_cm) * 10::DOUBLE / length_mm, 0) AS g, {cluster} AS cl, {n._FREE} AS free FROM tracks)"
    pool = "pool AS (SELECT 'light' AS family, path_id, seq, length_mm, CASE WHEN lower(lit) IN ('yes', '24/7', 'on') THEN 'lit' ELSE 'unlit' END AS kind FROM rws UNION ALL SELECT 'hill', path_id, seq, length_mm, 'steep' FROM rws WHERE g > 0.033 OR g < -0.033 UNION ALL SELECT 'cycle', path_id, seq, length_mm, CASE cl WHEN 1 THEN 'segregated' WHEN 2 THEN 'bus_shared' WHEN 3 THEN 'car_shared' ELSE CASE WHEN free THEN 'segregated' ELSE 'network' END END FROM rws WHERE cl IS NOT NULL OR free OR programme <> '')"
    return paths._TRACKS + f", {rows}, {pool} SELECT family, path_id, run, min(seq) AS first_seq, max(seq) AS last_seq, any_value(kind) AS kind, sum(length_mm)::BIGINT AS length_mm FROM (SELECT *, sum(fresh) OVER (PARTITION BY family, path_id ORDER BY seq)::BIGINT - 1 AS run FROM (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM pool WINDOW w AS (PARTITION BY family, path_id ORDER BY seq))) GROUP BY 1, 2, 3"


_MM = "CASE WHEN way_id % 3 = 0 THEN 1000 + k * 977 % 5000 ELSE 5000 + k * 3571 % 55000 END"
_RECURSIVE = net.SQL.replace("WITH grid", "WITH RECURSIVE grid", 1)
_SPHERE = lambda ax, ay, bx, by: f"2 * 6371000::DOUBLE * asin(least(1, sqrt(sin(radians({by} / 1e6::DOUBLE - {ay} / 1e6::DOUBLE) / 2) ** 2 + cos(radians({ay} / 1e6::DOUBLE)) * cos(radians({by} / 1e6::DOUBLE)) * sin(radians({bx} / 1e6::DOUBLE - {ax} / 1e6::DOUBLE) / 2) ** 2)))"


def _window_sql() -> str:
    """Every walk of at most 15 m."""
    return _RECURSIVE + f", l AS (SELECT u, v, min({_MM}) AS mm FROM edges GROUP BY 1, 2), r AS (SELECT node_id AS s, node_id AS n, 0::BIGINT AS d FROM nodes UNION SELECT s, l.v, d + mm FROM r JOIN l ON l.u = n WHERE d + mm <= 15000) SELECT s AS node_id, count(*) AS n, sum(elev_cm)::BIGINT * 10 // count(*) AS mm FROM (SELECT DISTINCT s, n AS m FROM r) JOIN nodes ON node_id = m GROUP BY 1"


def _anchored_sql() -> str:
    """Every walk from a run's end that first gets to 30 m off the run; runs are found as neighbours in a row."""
    return _RECURSIVE + f""", b AS (SELECT u, v FROM ways WHERE way_id % 2 = 0 AND k % 5 < 2), m AS (SELECT u AS node_id FROM b UNION SELECT v FROM b),
s AS (SELECT node_id, sum(CASE WHEN node_id - 1 IN (SELECT u FROM b) THEN 0 ELSE 1 END) OVER (ORDER BY node_id) AS grp FROM m), a AS (SELECT node_id, min(node_id) OVER (PARTITION BY grp) AS component, max(node_id) OVER (PARTITION BY grp) AS other FROM s),
l AS (SELECT u, v, min(mm) AS mm FROM (SELECT u, v, {_MM} AS mm FROM ways UNION ALL SELECT v, u, {_MM} FROM ways) GROUP BY 1, 2),
onto AS MATERIALIZED (SELECT l.u, l.v, l.mm, a.component FROM l LEFT JOIN a ON a.node_id = l.v),
walk AS (SELECT DISTINCT component, e AS src, e AS n, 0::BIGINT AS d FROM (SELECT component, unnest([component, other]) AS e FROM a) UNION SELECT w.component, src, v, d + mm FROM walk w JOIN onto ON u = n WHERE d < 30000 AND onto.component IS DISTINCT FROM w.component),
least AS (SELECT component, src, n, min(d) AS d FROM walk GROUP BY 1, 2, 3), found AS (SELECT component, src, min((d, n))[2] AS anchor FROM least WHERE d >= 30000 GROUP BY 1, 2),
pair AS (SELECT c.component, coalesce(p.anchor, c.component) AS anchor_a, coalesce(q.anchor, c.other) AS anchor_b FROM (SELECT DISTINCT component, other FROM a) c LEFT JOIN found p ON p.component = c.component AND p.src = c.component LEFT JOIN found q ON q.component = c.component AND q.src = c.other),
x AS (SELECT a.node_id, component, anchor_a, anchor_b, o.elev_cm, f.elev_cm AS ha, g.elev_cm AS hb, {_SPHERE('f.x_u', 'f.y_u', 'g.x_u', 'g.y_u')} AS total, {_SPHERE('f.x_u', 'f.y_u', 'o.x_u', 'o.y_u')} AS part FROM a JOIN pair USING (component) JOIN nodes o ON o.node_id = a.node_id JOIN nodes f ON f.node_id = anchor_a JOIN nodes g ON g.node_id = anchor_b)
SELECT node_id, component, anchor_a, anchor_b, {_m('CASE WHEN total = 0 THEN elev_cm ELSE ha + (hb - ha) * greatest(0, least(1, part / total)) END', 10)} AS mm FROM x"""


def _ellipsoid_sql() -> str:
    """The same rounds as a chain of tables."""
    a, b = geo.WGS84
    f, e = (a - b) / a, (a * a - b * b) / (b * b)
    n = lambda x: f"{x!r}::DOUBLE"
    out = shapes_of._BASE + f", l0 AS (SELECT way_id, radians(vx / 1e6::DOUBLE - ux / 1e6::DOUBLE) AS l, radians(vx / 1e6::DOUBLE - ux / 1e6::DOUBLE) AS lam, atan({n(1 - f)} * tan(radians(uy / 1e6::DOUBLE))) AS a1, atan({n(1 - f)} * tan(radians(vy / 1e6::DOUBLE))) AS a2, {_SPHERE('ux', 'uy', 'vx', 'vy')} AS sphere FROM streets)"
    solved = "(SELECT *, atan2(sn, cs) AS arc, CASE WHEN sq = 0 THEN 0 ELSE cs - 2 * sin(a1) * sin(a2) / sq END AS mid FROM (SELECT *, 1 - alpha * alpha AS sq FROM (SELECT *, CASE WHEN sn = 0 THEN 0 ELSE cos(a1) * cos(a2) * sin(lam) / sn END AS alpha FROM (SELECT *, sqrt((cos(a2) * sin(lam)) ** 2 + (cos(a1) * sin(a2) - sin(a1) * cos(a2) * cos(lam)) ** 2) AS sn, sin(a1) * sin(a2) + cos(a1) * cos(a2) * cos(lam) AS cs FROM {}))))"
    for i in range(8):
        out += f", l{i + 1} AS (SELECT way_id, l, l + (1 - c) * {n(f)} * alpha * (arc + c * sn * (mid + c * cs * (2 * mid * mid - 1))) AS lam, a1, a2, sphere FROM (SELECT *, {n(f / 16)} * sq * (4 + {n(f)} * (4 - 3 * sq)) AS c FROM {solved.format(f'l{i}')}))"
    out += f", k AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM (SELECT *, sq * {n(e)} AS u FROM {solved.format('l8')}))"
    length = f"{n(b)} * big * (arc - small * sn * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * sn * sn - 3) * (4 * mid * mid - 3))))"
    return out + f" SELECT way_id, {_m(length)} AS geodesic_mm, {_m('sphere')} AS sphere_mm FROM k"


def _grid_sql() -> str:
    """The shift, the series and both back, as a chain of tables."""
    n = lambda x: f"({x!r}::DOUBLE)"
    radius, plane, back, lat, e = geo._series()
    sinh, cosh = (lambda x: f"((exp({x}) - exp(-({x}))) / 2)"), (lambda x: f"((exp({x}) + exp(-({x}))) / 2)")
    atanh = lambda x: f"(ln((1 + {x}) / (1 - {x})) / 2)"

    def shift(src: str, sign: int, name: str) -> str:
        (a, b), (ta, tb) = (geo.WGS84, geo.AIRY) if sign > 0 else (geo.AIRY, geo.WGS84)
        e2, te2, k = 1 - (b / a) ** 2, 1 - (tb / ta) ** 2, 1 + sign * geo.SCALE_PPM * 1e-6
        rx, ry, rz = (n(sign * geo.math.radians(r / 3600)) for r in geo.TURNS)
        dx, dy, dz = (n(sign * d) for d in geo.SHIFT)
        return f""", {name}0 AS (SELECT *, r * cos(radians(lat)) * cos(radians(lon)) AS x, r * cos(radians(lat)) * sin(radians(lon)) AS y, r * {n(1 - e2)} * sin(radians(lat)) AS z FROM (SELECT *, {n(a)} / sqrt(1 - {n(e2)} * sin(radians(lat)) ** 2) AS r FROM {src})),
{name}1 AS (SELECT * REPLACE ({dx} + {n(k)} * x - {rz} * y + {ry} * z AS x, {dy} + {rz} * x + {n(k)} * y - {rx} * z AS y, {dz} - {ry} * x + {rx} * y + {n(k)} * z AS z) FROM {name}0),
{name} AS (SELECT * EXCLUDE (lon, lat, x, y, z, r), degrees(atan2(y, x)) AS lon, degrees(atan2(z + {n(te2 * ta * ta / tb)} * sin(atan2(z * {n(ta)}, sqrt(x * x + y * y) * {n(tb)})) ** 3, sqrt(x * x + y * y) - {n(te2 * ta)} * cos(atan2(z * {n(ta)}, sqrt(x * x + y * y) * {n(tb)})) ** 3)) AS lat FROM {name}1)"""

    term = lambda cs, x, y, f, g, sign: "".join(f" {sign} {n(c)} * {f}({2 * j + 2} * {x}) * {g(f'{2 * j + 2} * {y}')}" for j, c in enumerate(cs))
    scale, origin = geo.GRID_SCALE * radius, geo._meridian()
    out = net.SQL + ", p AS (SELECT node_id, x_u / 1e6::DOUBLE AS lon, y_u / 1e6::DOUBLE AS lat FROM nodes)" + shift("p", 1, "brit")
    out += f", conf AS (SELECT *, {sinh(atanh('sin(radians(lat))') + f' - {n(e)} * ' + atanh(f'({n(e)} * sin(radians(lat)))'))} AS t, radians(lon - {n(geo.GRID_LON)}) AS l FROM brit)"
    out += f", sph AS (SELECT node_id, atan2(t, cos(l)) AS xi, {atanh('(sin(l) / sqrt(1 + t * t))')} AS eta FROM conf)"
    out += f", grd AS (SELECT node_id, {n(geo.GRID_EAST)} + {n(scale)} * (eta{term(plane, 'xi', 'eta', 'cos', sinh, '+')}) AS east, {n(geo.GRID_NORTH)} + {n(scale)} * (xi{term(plane, 'xi', 'eta', 'sin', cosh, '+')} - {n(origin)}) AS north FROM sph)"
    out += f", flat AS (SELECT *, (north - {n(geo.GRID_NORTH)}) / {n(scale)} + {n(origin)} AS x, (east - {n(geo.GRID_EAST)}) / {n(scale)} AS y FROM grd)"
    out += f", ball AS (SELECT node_id, east, north, x{term(back, 'x', 'y', 'sin', cosh, '-')} AS xi, y{term(back, 'x', 'y', 'cos', sinh, '-')} AS eta FROM flat)"
    out += f", chi AS (SELECT node_id, east, north, asin(sin(xi) / {cosh('eta')}) AS chi, atan2({sinh('eta')}, cos(xi)) AS l FROM ball)"
    out += f", again AS (SELECT node_id, east, north, degrees(l) + {n(geo.GRID_LON)} AS lon, degrees(chi" + "".join(f" + {n(c)} * sin({2 * j + 2} * chi)" for j, c in enumerate(lat)) + ") AS lat FROM chi)" + shift("again", -1, "world")
    return out + f" SELECT node_id, {_m('east', 10)} AS east_dm, {_m('north', 10)} AS north_dm, {_m('lon', '1e6')} AS lon_u, {_m('lat', '1e6')} AS lat_u FROM world"


ORACLE_SQL = {
    "g15_road_window": _window_sql(),
    "g13_anchored_bridges": _anchored_sql(),
    "x07_ellipsoid_lengths": _ellipsoid_sql(),
    "x05_british_grid": _grid_sql(),
    "s16_samples": _PLACES + " SELECT id, CASE WHEN val IS NULL OR node_id % 17 = 0 THEN 0 ELSE val END AS cm FROM spot LEFT JOIN cells USING (r, c)",
    "x08_weighted_heights": _PLACES + f", p AS (SELECT id, val, (px + 100000 - q.c * 1000 - 500) ** 2 + (py - 51500000 - q.r * 1000 - 500) ** 2 AS d2 FROM spot s JOIN cells q ON abs(q.r - s.r) <= 1 AND abs(q.c - s.c) <= 1 WHERE node_id % 17 <> 0), w AS (SELECT id, val, CASE WHEN d2 = 0 THEN 1e12 ELSE 1e6 / d2 END AS w FROM p) SELECT id, {_m('sum(w * val) / sum(w)', 10)} AS mm FROM w GROUP BY 1",
    "x09_median_heights": _PLACES + f" SELECT id, {_m('quantile_cont(val, 0.5)', 10)} AS mm, count(*) AS cells FROM spot s JOIN cells q ON abs(q.r - s.r) <= 2 AND abs(q.c - s.c) <= 2 WHERE node_id % 17 <> 0 GROUP BY 1",
    "x10_grades": _SHORT + f" SELECT u, v, {_m(_clip('grade', 0.3), 10000)} AS legacy, {_m(_clip('CASE WHEN mm < 5000 OR type IN (' + chr(39) + 'footway' + chr(39) + ', ' + chr(39) + 'steps' + chr(39) + ') THEN 0 ELSE grade END', 0.2), 10000)} AS grade FROM g",
    "x11_damped_grades": _SHORT + f", pr AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM g WHERE abs(grade) > 0.04), dg AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM pr UNION ALL SELECT b FROM pr) GROUP BY 1), z AS (SELECT g.*, coalesce(x.n, 0) <= 1 AND coalesce(y.n, 0) <= 1 AS alone FROM g LEFT JOIN dg x ON x.node = u LEFT JOIN dg y ON y.node = v) SELECT u, v, {_m(_clip('grade * CASE WHEN abs(grade) > 0.04 AND alone THEN CASE WHEN mm < 12000 THEN 0 WHEN mm < 20000 THEN 0.3::DOUBLE WHEN mm < 35000 THEN 0.5::DOUBLE ELSE 1 END ELSE 1 END', 0.2), 10000)} AS grade FROM z",
    "g14_rivers": net.SQL + ", f AS (SELECT u, v FROM ways WHERE is_river = 'yes'), h0 AS (SELECT node_id, elev_cm AS e FROM nodes)" + "".join(f", h{i} AS (SELECT h.node_id, least(h.e, q.low) AS e FROM h{i - 1} h LEFT JOIN (SELECT v, min(e) AS low FROM f JOIN h{i - 1} ON u = node_id GROUP BY 1) q ON q.v = h.node_id)" for i in range(1, 6)) + " SELECT node_id, e AS elev_cm FROM h5",
    "g15_smoothed": net.SQL + ", l AS (SELECT u, v, min(length_mm) AS mm FROM edges GROUP BY 1, 2), r AS (SELECT u, v FROM l WHERE mm <= 150000 UNION SELECT a.u, b.v FROM l a JOIN l b ON a.v = b.u WHERE a.mm + b.mm <= 150000 UNION SELECT node_id, node_id FROM nodes) SELECT u AS node_id, count(*) AS n, sum(elev_cm)::BIGINT * 10 // count(*) AS mm FROM r JOIN nodes ON node_id = v GROUP BY 1",
    "g13_bridges": net.SQL + f", b AS (SELECT u, v FROM ways WHERE way_id % 2 = 0 AND k % 5 < 2), m AS (SELECT DISTINCT x AS node_id FROM (SELECT u AS x FROM b UNION ALL SELECT v FROM b)), s AS (SELECT *, sum(CASE WHEN node_id - 1 IN (SELECT u FROM b) THEN 0 ELSE 1 END) OVER (ORDER BY node_id) AS grp FROM m), a AS (SELECT node_id, min(node_id) OVER (PARTITION BY grp) AS component, x_u, elev_cm, grp FROM s JOIN nodes USING (node_id)), q AS (SELECT *, first_value(x_u) OVER w AS ax, first_value(elev_cm) OVER w AS ae, last_value(x_u) OVER w AS bx, last_value(elev_cm) OVER w AS be FROM a WINDOW w AS (PARTITION BY grp ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT node_id, component, {_m('ae + (be - ae) * ((x_u - ax) / (bx - ax)::DOUBLE)', 10)} AS mm FROM q",
    "x01_measures": net.SQL + f", s AS (SELECT way_id, a.x_u AS ux, a.y_u AS uy, b.x_u AS vx, b.y_u AS vy, (way_id % 7 - 3)::DOUBLE AS px, (way_id % 5 - 2)::DOUBLE AS py FROM ways JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v) SELECT way_id, {_m('2 * 6371000::DOUBLE * asin(sqrt(sin(radians((vy - uy) / 1e6::DOUBLE) / 2) ** 2 + cos(radians(uy / 1e6::DOUBLE)) * cos(radians(vy / 1e6::DOUBLE)) * sin(radians((vx - ux) / 1e6::DOUBLE) / 2) ** 2))')} AS mm, {_m('CASE WHEN px = 0 AND py = 0 THEN 0 ELSE degrees(acos(least(1, abs((vx - ux) * px + (vy - uy) * py) / (sqrt(((vx - ux) ** 2 + (vy - uy) ** 2)::DOUBLE) * sqrt(px * px + py * py))))) END')} AS angle_milli, {_m('CASE WHEN way_id % 12 > 5 THEN 0.5::DOUBLE ELSE greatest(0, 1 - (way_id % 60) / 1e6::DOUBLE * 111000 / 4) END')} AS confidence_milli FROM s",
    "x05_projected": net.SQL + f"SELECT node_id, {_m('radians(x_u / 1e6::DOUBLE) * 6378137::DOUBLE', 10)} AS x_dm, {_m('ln(tan(pi() / 4 + radians(y_u / 1e6::DOUBLE) / 2)) * 6378137::DOUBLE', 10)} AS y_dm, x_u AS lon_u, y_u AS lat_u FROM nodes",
    "x45_shapes": net.SQL + f", q AS (SELECT gy AS line, count(*) AS n, min(y_u) AS south, max(y_u) AS north, min(x_u) AS west, max(x_u) AS east FROM nodes WHERE gx < 12 GROUP BY 1) SELECT line, south, north, west, east, {_m('south', 10)} AS mid_lat, {_m('(west + east) / 2::DOUBLE', 10)} AS mid_lon, west AS first_lon, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[[' || west || ',' || south || '],[' || east || ',' || south || ']]}},\"properties\":{{\"id\":' || line || '}}}}' AS feature FROM q",
    "w12_positions": _RUN + f", want AS (SELECT DISTINCT path_id, total, i AS tenth, total * i // 10 AS d FROM run, range(11) AS q(i)) SELECT path_id, cast(tenth AS INTEGER) AS tenth, seq, {_m('(d - start_mm) / length_mm::DOUBLE', '1e6')} AS ppm FROM want JOIN run USING (path_id) WHERE d > start_mm AND d <= end_mm OR d = 0 AND start_mm = 0",
    "w13_slices": _RUN + ", g AS (SELECT path_id, seq, start_mm, end_mm, total, greatest(400000, total * 15 // 100) AS least, CASE WHEN is_park = 'yes' THEN 'park' ELSE 'river' END AS kind FROM run WHERE is_park = 'yes' OR is_river = 'yes'), f AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND (start_mm - lag(end_mm) OVER w) * 2 < least THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY path_id ORDER BY seq)), s AS (SELECT path_id, slice, any_value(kind) AS kind, min(start_mm) AS a, max(end_mm) AS b, max(least) AS least, max(total) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY seq)::BIGINT - 1 AS slice FROM f) GROUP BY 1, 2) SELECT path_id, slice, kind, CASE WHEN b - a < least THEN greatest(0, (a + b) // 2 - least // 2) ELSE a END AS d0, CASE WHEN b - a < least THEN least(total, (a + b) // 2 + least // 2) ELSE b END AS d1 FROM s",
    "w05_typed_runs": _typed_sql(),
}
