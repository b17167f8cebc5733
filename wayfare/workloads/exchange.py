"""Queries that write tables as the exchange files of feeds and networks and read them back through the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.sources import feeds as fd
from wayfare.sources import network as src
from wayfare.session import remove_folder, settle, shared_folder
from wayfare.sources import shapefile
from wayfare.workloads import spatial as sp


def _where(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as CSV and read again: two columns of any case, one that isn't there."""
    where = _where(spark, "csv")
    spark.read.parquet(f"{sf}/customer.parquet").write.option("header", True).csv(where)
    out = src.csv(spark, where, ["C_CUSTKEY", "c_mktsegment", "c_fax"], {"c_mktsegment": "segment"})
    return out.select(F.col("C_CUSTKEY").cast("bigint").alias("id"), "segment")


def _features(rows: DataFrame, feature, of: int) -> DataFrame:
    """Features as text, some in each collection."""
    return rows.groupBy((F.col("id") % of).alias("_g")).agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("value"))


def shapefile_roads(spark: SparkSession, sf: str) -> DataFrame:
    """Streets written as shapefiles and read again: attributes that are there, named streets that a view's box meets."""
    where = _where(spark, "shapefile")
    s = sp._streets(spark, sf).select(F.col("way_id").alias("osm_id"), F.col("type").alias("fclass"), F.array(F.array(*[F.struct((F.col(f"{e}x") / 1e6).alias("x"), (F.col(f"{e}y") / 1e6).alias("y")) for e in "uv"])).alias("parts"))
    shapefile.write(s.join(net.ways(spark, sf).select(F.col("way_id").alias("osm_id"), "name"), "osm_id"), where)
    x0, y0, x1, y1 = (c / 1e6 for c in sp.VIEW)
    got = shapefile.read(spark, where, ["osm_id", "code", "fclass", "name", "ref"])
    got = got.filter((F.col("xmax") > x0) & (F.col("xmin") < x1) & (F.col("ymax") > y0) & (F.col("ymin") < y1) & F.col("name").isNotNull())
    micro = lambda c, n: F.floor(c * 1e6 + 0.5).cast("bigint").alias(n)
    out = settle(got.select("osm_id", "fclass", "name", F.size(got["parts"][0]).cast("bigint").alias("points"), micro(F.col("xmin"), "west"), micro(got["parts"][0][1]["y"], "end_y")))
    remove_folder(spark, where)
    return out


def programme_segments(spark: SparkSession, sf: str) -> DataFrame:
    where = _where(spark, "routes")
    pts = net.nodes(spark, sf).groupBy(F.col("gy").alias("id")).agg(F.sort_array(F.collect_list(F.struct("gx", "x_u", "y_u"))).alias("p"))
    name = F.element_at(F.array(*map(F.lit, ("Cycleways", "Quietways", "Cycle Superhighways", "Footpaths"))), F.expr("cast(id % 4 + 1 as int)"))
    line = F.transform("p", lambda q: F.array(q["x_u"] / 1e6, q["y_u"] / 1e6))
    kind = F.when(F.col("id") % 9 == 8, "LineString").otherwise("MultiLineString")
    feature = F.struct(F.struct(name.alias("Programme"), F.concat(F.lit(" R"), F.col("id")).alias("Label")).alias("properties"), F.struct(kind.alias("type"), F.array(line, F.slice(line, 1, 1)).alias("coordinates")).alias("geometry"))
    _features(pts, feature, 7).write.text(where)
    s = fd.programme_segments(spark, where)
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(c)
    return s.select("tag", "label", F.col("seq").cast("bigint").alias("seq"), *[micro(c) for c in ("ax", "ay", "bx", "by")])


def polygon_rings(spark: SparkSession, sf: str) -> DataFrame:
    where = _where(spark, "polygons")
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("id"), "n_name")
    x, y = F.col("id") % 5, F.floor(F.col("id") / 5)
    corner = lambda dx, dy: F.array((x + dx).cast("double"), (y + dy).cast("double"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), F.when(F.col("id") % 6 == 0, corner(0, 1)).otherwise(corner(0, 0)))
    feature = F.struct(F.create_map(F.lit("name"), F.col("n_name")).alias("properties"), F.struct(F.when(F.col("id") % 7 == 6, "Point").otherwise("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    _features(n, feature, 3).write.text(where)
    r = fd.polygon_rings(spark, where, "name")
    return r.select("name", F.size("points").alias("n"), F.element_at("points", 2)["lat"].cast("bigint").alias("lat2"), F.element_at("points", 2)["lon"].cast("bigint").alias("lon2"), "closed")


def disruption_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of one record a line in which some lines are broken and some have no id."""
    where = _where(spark, "feed-a")
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 10 == 0, None).otherwise(F.concat(F.lit("D"), F.col("event_id"))).alias("id"), F.element_at(F.array(F.lit("Works"), F.lit("Collisions")), F.expr("cast(event_id % 2 + 1 as int)")).alias("category"), F.lit("Moderate").alias("severity"), F.lit("Active").alias("status"))
    e.select(F.when(F.col("event_id") % 13 == 0, F.lit('{"id": "half')).otherwise(F.to_json(F.struct("id", "category", "severity", "status"))).alias("value")).write.text(where)
    return fd.disruptions(spark, where).select("id", "category", "severity", "status")


def incident_scan(spark: SparkSession, sf: str) -> DataFrame:
    where = _where(spark, "feed-b")
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'").select(F.col("event_id").alias("id"))
    rec = F.struct(F.struct(F.concat(F.lit("I"), F.col("id")).alias("id"), (F.col("id") % 16).alias("iconCategory"), (F.col("id") % 6).alias("magnitudeOfDelay"), F.lit("x").alias("other")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array((F.col("id") % 100) / 100.0, (F.col("id") % 77) / 77.0).alias("coordinates")).alias("geometry"))
    e.groupBy((F.col("id") % 5).alias("_g")).agg(F.collect_list(rec).alias("incidents")).select(F.to_json(F.struct("incidents")).alias("value")).write.text(where)
    return fd.incidents(spark, where, (0.25, 0.1, 0.5, 0.6)).select("id", "icon", "delay")


def station_scan(spark: SparkSession, sf: str) -> DataFrame:
    where = _where(spark, "stations")
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("commonName"))
    kv = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    props = F.array(kv("Installed", F.when(F.col("k") % 5 == 0, "false").otherwise("True")), kv("Locked", F.when(F.col("k") % 7 == 0, "true").otherwise("false")), kv("NbBikes", (F.col("k") % 20).cast("string")), kv("NbEmptyDocks", F.lit("x")), kv("NbDocks", (F.col("k") % 30).cast("string")))
    s.select(F.to_json(F.struct(F.concat(F.lit("S"), F.col("k")).alias("id"), "commonName", (F.col("k") / 1000.0).alias("lat"), (F.col("k") / 500.0).alias("lon"), props.alias("additionalProperties"))).alias("value")).write.text(where)
    return src.stations(spark, where, multi_line=False).select("id", "name", "bikes", "empty", "docks")


def exported_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Edge tags written out, cleared, and read back onto the edges."""
    where = _where(spark, "tags")
    e = net.edges(spark, sf).groupBy("u", "v").agg(F.max("programme").alias("programme")).withColumn("route", F.when(F.col("u") % 9 == 0, F.concat(F.lit("R"), F.col("u"))).otherwise(""))
    fd.export_tags(e, where)
    return fd.import_tags(e.withColumns({"programme": F.lit(""), "route": F.lit("")}), where)


def replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table written twice: the second writing, in chunks of districts, stands alone."""
    where = _where(spark, "table")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    fd.replace_table(o, where)
    fd.replace_table(o.filter("id % 2 = 0"), where, F.col("id") % 4)
    return spark.read.parquet(where).select("id", F.col("chunk").cast("bigint").alias("chunk"))


def monthly_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of months over four batches, each added to what the last one wrote."""
    where = _where(spark, "counters")
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % 4).alias("batch"), F.date_format("ts", "yyyy-MM").alias("month"), F.lit(1).alias("n"))
    for b in range(4):
        fd.counted(spark, where, e.filter(F.col("batch") == b), b)
    return fd.newest(spark, where, [0, 1, 2, 3]).select("month", "n")


def stored_network(spark: SparkSession, sf: str) -> DataFrame:
    """A network kept with its fingerprint is used again only for the same edges and formula."""
    where = _where(spark, "network")
    e = settle(net.edges(spark, sf).select("u", "v", "way_id", "length_mm"))
    src.save(net.nodes(spark, sf).select("node_id"), e, where, "v1")
    tries = {"same": (e, "v1"), "other formula": (e, "v2"), "other edges": (e.filter("u > 0"), "v1")}
    rows = [(k, src.load(spark, where, edges, formula) is not None) for k, (edges, formula) in tries.items()]
    kept = src.load(spark, where, e, "v1")[1].agg(F.count("*").alias("edges"), F.sum("length_mm").alias("length_mm"))
    return spark.createDataFrame(rows, "try string, used boolean").crossJoin(F.broadcast(kept))


QUERIES = {"s03_shapefile_roads": shapefile_roads, "s02_csv_round_trip": csv_round_trip, "s10_programme_segments": programme_segments, "s11_polygon_rings": polygon_rings, "s12_disruption_scan": disruption_scan, "s13_incident_scan": incident_scan, "s14_station_scan": station_scan, "s19_exported_tags": exported_tags, "s07_replaced_table": replaced_table, "s21_monthly_counters": monthly_counters, "s18_stored_network": stored_network}

ORACLE_SQL = {
    "s03_shapefile_roads": net.SQL + sp._STREETS + f" SELECT way_id AS osm_id, ways.type AS fclass, name, 2::BIGINT AS points, ux AS west, vy AS end_y FROM streets JOIN ways USING (way_id) WHERE name <> '' AND vx > {sp.VIEW[0]} AND ux < {sp.VIEW[2]} AND vy > {sp.VIEW[1]} AND uy < {sp.VIEW[3]}",
    "s02_csv_round_trip": "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer",
    "s10_programme_segments": net.SQL + "SELECT (['cycleway', 'quietway', 'superhighway'])[a.gy % 4 + 1] AS tag, 'R' || a.gy AS label, a.gx AS seq, a.x_u AS ax, a.y_u AS ay, b.x_u AS bx, b.y_u AS by FROM nodes a JOIN nodes b ON b.gy = a.gy AND b.gx = a.gx + 1 WHERE a.gy % 4 < 3 AND a.gy % 9 <> 8",
    "s11_polygon_rings": "SELECT n_name AS name, 5 AS n, (n_nationkey // 5)::BIGINT AS lat2, (n_nationkey % 5 + 1)::BIGINT AS lon2, n_nationkey % 6 <> 0 AS closed FROM nation WHERE n_nationkey % 7 <> 6",
    "s12_disruption_scan": "SELECT 'D' || event_id AS id, (['Works', 'Collisions'])[event_id % 2 + 1] AS category, 'Moderate' AS severity, 'Active' AS status FROM events WHERE event_type = 'error' AND event_id % 10 <> 0 AND event_id % 13 <> 0",
    "s13_incident_scan": "SELECT 'I' || event_id AS id, event_id % 16 AS icon, event_id % 6 AS delay FROM events WHERE event_type = 'click' AND event_id % 100 BETWEEN 25 AND 50 AND event_id % 77 / 77::DOUBLE BETWEEN 0.1::DOUBLE AND 0.6::DOUBLE",
    "s14_station_scan": "SELECT 'S' || s_suppkey AS id, s_name AS name, cast(s_suppkey % 20 AS INTEGER) AS bikes, NULL::INTEGER AS empty, cast(s_suppkey % 30 AS INTEGER) AS docks FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0",
    "s19_exported_tags": net.SQL + "SELECT u, v, max(programme) AS programme, CASE WHEN u % 9 = 0 THEN 'R' || u ELSE '' END AS route FROM edges GROUP BY u, v",
    "s07_replaced_table": "SELECT o_orderkey AS id, o_orderkey % 4 AS chunk FROM orders WHERE o_orderkey % 2 = 0",
    "s21_monthly_counters": "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1",
    "s18_stored_network": net.SQL + "SELECT t AS try, t = 'same' AS used, edges, length_mm FROM (SELECT count(*) AS edges, sum(length_mm)::BIGINT AS length_mm FROM edges), unnest(['same', 'other formula', 'other edges']) AS q(t)",
}
