"""Data-quality reports over the network: coverage, distributions, bands, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions import tags as t
from wayfare.operators.runs import until_enough
from wayfare.workloads import spatial

TAGS = ("surface", "lit", "maxspeed", "width", "cycleway", "barrier", "programme", "name")
#: What counts as no value.
EMPTY = ("", "0", "0.0", "none")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", *TAGS).unpivot("way_id", list(TAGS), "tag", "value")


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    has = F.sum((~F.lower("value").isin(*EMPTY)).cast("bigint"))
    return _long(spark, sf).groupBy("tag").agg(has.alias("filled"), F.count("*").alias("total"), (has * 1000).alias("x")).select("tag", "filled", "total", F.expr("x div total").alias("permille"))


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 most frequent values of each tag, with their share and the number of different values."""
    n = _long(spark, sf).filter(~F.lower("value").isin(*EMPTY)).groupBy("tag", "value").agg(F.count("*").alias("n"))
    of = n.groupBy("tag").agg(F.sum("n").alias("all_n"), F.count("*").alias("distinct_n"))
    r = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "value"))
    return n.withColumn("rank", r).filter("rank <= 20").join(F.broadcast(of), "tag").select("tag", "value", "n", "rank", F.expr("n * 1000 div all_n").alias("permille"), "distinct_n")


def risk_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = net.ways(spark, sf).withColumn("r", F.when(F.col("risk_milli") > 0, F.col("risk_milli")))
    return w.agg(F.count("r").alias("with_risk"), F.min("r").alias("least"), F.max("r").alias("most"), F.expr("sum(r) div count(r)").alias("mean"), F.min("risk_milli").alias("floor"))


def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conf_tenths")
    band = F.when(c <= 0, "none").when(c < 5, "low").when(c < 10, "high").otherwise("full")
    return net.ways(spark, sf).filter("barrier <> ''").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def elevation(spark: SparkSession, sf: str) -> DataFrame:
    e = net.edges(spark, sf)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return e.agg(F.sum(F.greatest(F.col("rise_cm"), F.lit(0))).alias("ascent_cm"), count(F.col("grade") > t.UP).alias("steep"), F.sum("length_mm").alias("length_mm"), count(F.col("grade") > 0.001).alias("up"), count(F.col("grade") < -0.001).alias("down"), count(F.abs("grade") <= 0.001).alias("flat"))


def hours_catalog(spark: SparkSession, sf: str) -> DataFrame:
    part = F.explode(F.transform(F.split("opening_hours", ";"), lambda x: F.trim(x)))
    return net.ways(spark, sf).select(part.alias("hours")).filter("hours <> ''").distinct()


def undirected(spark: SparkSession, sf: str) -> DataFrame:
    return net.edges(spark, sf).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def tiered(spark: SparkSession, sf: str, most: int = 20_000) -> DataFrame:
    """As many streets as are asked for: those with a known surface first, then the rest by distance from the centre."""
    s = spatial._streets(spark, sf).select("way_id", (F.col("ux") + F.col("vx") + 160_000).alias("dx"), (F.col("uy") + F.col("vy") - 103_040_000).alias("dy"))
    known = net.ways(spark, sf).select("way_id", F.when(F.col("surface") == "cobblestone", 0).otherwise(1).alias("tier"))
    return s.join(known, "way_id").select("way_id", "tier", F.expr("if(tier = 0, 0, dx * dx + dy * dy)").alias("d2")).orderBy("tier", "d2", "way_id").limit(most)


def hire_stations(spark: SparkSession, sf: str) -> DataFrame:
    """For each customer's place the stations within reach by distance, up to the third with bikes."""
    st = spatial._points(spark, sf, "supplier", "s_suppkey", 500).toDF("station", "qx", "qy").withColumn("bikes", F.expr("station % 3"))
    from wayfare.operators.spatial import points_near_points

    near = points_near_points(spatial._points(spark, sf, "customer", "c_custkey", 500), st, 3000)
    return until_enough(near, "id", [F.col("d2"), F.col("station")], F.col("bikes") > 0, 3).select("id", "station", "d2", "bikes")


def programme_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 most frequent programmes over directed edges."""
    part = net.edges(spark, sf).select(F.explode(F.split("programme", ";")).alias("programme")).filter("programme <> ''")
    return part.groupBy("programme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "programme").limit(30)


def penalty_floors(spark: SparkSession, sf: str) -> DataFrame:
    """The least penalty that every edge pays: 0 where one edge pays none."""
    e = net.edges(spark, sf)
    least = lambda free, cost: F.when(F.bool_or(free), 0.0).otherwise(cost)
    milli = lambda c: F.floor(c * 1000 + 0.5).cast("bigint")
    rows = e.agg(least(F.col("risk_milli") <= 0, F.min(F.when(F.col("risk_milli") > 0, F.col("risk_milli") / 1000))).alias("risk"), least(t.is_lit(), F.lit(0.5)).alias("light"), least(~t.rough(), F.lit(3.0)).alias("surface"), least(t.speed_stress(t.max_speed_kmh()) <= 0, F.lit(0.15)).alias("speed"))
    return rows.select(*[milli(F.col(c)).alias(c) for c in rows.columns])


def hours_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Park streets open and closed at four times, by whether they say their hours themselves."""
    from wayfare.functions.text import open_at

    times = spark.createDataFrame([(k, m, m < 360 or m > 1200) for k, m in enumerate((180, 600, 1080, 1380))], "slot int, minute int, dark boolean")
    parks = net.ways(spark, sf).filter(t.yes("is_park")).groupBy("opening_hours").agg(F.count("*").alias("streets"))
    # the catalogue of distinct hours, against four times
    each = parks.join(F.broadcast(times)).withColumn("open", open_at(F.col("opening_hours"), F.col("minute"), F.lit(2), F.col("dark")))
    return each.groupBy("slot", (F.trim("opening_hours") != "").alias("tagged"), "open").agg(F.sum("streets").alias("streets"), F.count("*").alias("strings"))


def live_status(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("edge_count"), F.max("ts").cast("string").alias("last_update"))


def height_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Median, mean and largest height difference by type of street, in centimetres."""
    d = net.edges(spark, sf).select("type", F.abs("rise_cm").alias("d"))
    return d.groupBy("type").agg(F.floor(F.percentile("d", 0.5) * 2 + 0.5).cast("bigint").alias("median_half"), F.expr("sum(d) div count(*)").alias("mean"), F.max("d").alias("most"))


def distance_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Largest detour of each weight class over its routes, with and without the rejected ones, largest first."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") % 13).alias("weight"), F.expr("o_orderkey * 7919 % 9001").alias("delta_m"), (F.col("o_orderkey") % 5 == 0).alias("rejected"))
    return o.groupBy("weight").agg(F.max("delta_m").alias("most"), F.coalesce(F.max(F.when(~F.col("rejected"), F.col("delta_m"))), F.lit(0)).alias("most_shipped"), F.count("*").alias("routes")).orderBy(F.desc("most"), "weight")


def consequences(spark: SparkSession, sf: str) -> DataFrame:
    """Links from a dominant weight to the class of what goes wrong, with their number."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") % 13).alias("weight"), F.expr("o_orderkey * 31 % 100").alias("delta"), F.expr("o_orderkey * 17 % 9").alias("hits"))
    kind = F.when(F.col("delta") >= 80, "detour").when(F.col("hits") >= 6, "danger").when((F.col("delta") >= 50) & (F.col("hits") >= 3), "both").otherwise("none")
    return o.groupBy("weight", kind.alias("kind")).agg(F.count("*").alias("n")).filter("kind <> 'none'")


def not_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose height isn't cached yet, in batches of 50 in order of id."""
    from wayfare.operators.ranking import global_rank

    n = net.nodes(spark, sf).select("node_id")
    left = n.join(n.filter("node_id % 3 = 0"), "node_id", "left_anti")
    return global_rank(left, ["node_id"], "r").select("node_id", F.expr("(r - 1) div 50").alias("batch"))


def clean_places(spark: SparkSession, sf: str) -> DataFrame:
    """Collisions of the districts in question that have both coordinates, renamed."""
    c = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("collision_id"), F.expr("o_orderkey % 70").alias("district"), F.expr("if(o_orderkey % 11 = 0, null, o_orderkey * 7919 % 50000)").alias("longitude"), F.expr("if(o_orderkey % 13 = 0, null, o_orderkey * 104729 % 50000)").alias("latitude"))
    return c.filter(F.col("district").isin(*range(1, 33), 57)).dropna(subset=["longitude", "latitude"]).withColumnsRenamed({"longitude": "lon", "latitude": "lat"})


def layers(spark: SparkSession, sf: str, allowed: tuple[str, ...] = ("calming", "barrier"), cluster: int | None = 3) -> DataFrame:
    """Points of the allowed layers, pooled; of barriers only one cluster, if one is asked for."""
    w = net.ways(spark, sf)
    calm = w.filter("calming <> ''").select("way_id", F.lit("calming").alias("layer"), F.col("calming").alias("value"), F.lit(None).cast("int").alias("cluster"))
    point = w.filter("calming_point <> ''").select("way_id", F.lit("calming").alias("layer"), F.col("calming_point").alias("value"), F.lit(None).cast("int").alias("cluster"))
    bar = w.filter("barrier <> ''").select("way_id", F.lit("barrier").alias("layer"), F.col("barrier").alias("value"), t.barrier_cluster().cast("int").alias("cluster"))
    sign = w.filter("lit <> ''").select("way_id", F.lit("light").alias("layer"), F.col("lit").alias("value"), F.lit(None).cast("int").alias("cluster"))
    pool = calm.unionByName(point).unionByName(bar).unionByName(sign).filter(F.col("layer").isin(*allowed))
    return pool if cluster is None else pool.filter((F.col("layer") != "barrier") | (F.col("cluster") == cluster))


QUERIES = {"a05_programme_counts": programme_counts, "a15_penalty_floors": penalty_floors, "a18_hours_audit": hours_audit, "a22_live_status": live_status, "a24_height_deltas": height_deltas, "a20_distance_effects": distance_effects, "a21_consequences": consequences, "s22_not_cached": not_cached, "f03_clean_places": clean_places, "u01_layers": layers, "a02_tag_coverage": coverage, "a03_value_distribution": distribution, "a04_risk_summary": risk_summary, "a06_confidence_bands": confidence_bands, "a07_elevation_metrics": elevation, "a14_hours_catalog": hours_catalog, "u04_undirected_pairs": undirected, "t02_tiered_fill": tiered, "w16_hire_stations": hire_stations}

_LONG = net.SQL + ", tall AS (" + " UNION ALL ".join(f"SELECT way_id, '{c}' AS tag, {c} AS value FROM ways" for c in TAGS) + ")"
_GONE = "lower(value) IN ('', '0', '0.0', 'none')"
ORACLE_SQL = {
    "a05_programme_counts": net.SQL + "SELECT p AS programme, count(*) AS n FROM edges, unnest(string_split(programme, ';')) AS q(p) WHERE p <> '' GROUP BY 1 ORDER BY n DESC, p LIMIT 30",
    "a15_penalty_floors": net.SQL + "SELECT CASE WHEN bool_or(risk_milli <= 0) THEN 0 ELSE min(risk_milli) END AS risk, CASE WHEN bool_or(lower(lit) IN ('yes', '24/7', 'on')) THEN 0 ELSE 500 END AS light, CASE WHEN bool_or(lower(surface) NOT IN ('gravel', 'cobblestone', 'dirt', 'sett')) THEN 0 ELSE 3000 END AS surface, CASE WHEN bool_or(maxspeed IN ('20 mph', '30')) THEN 0 ELSE 150 END AS speed FROM edges",
    "a18_hours_audit": net.SQL + ", o AS (SELECT opening_hours AS h, slot, CASE WHEN opening_hours = '24/7' THEN true WHEN opening_hours LIKE 'Mo%' THEN slot IN (1, 2) ELSE slot IN (1, 2) END AS open FROM ways, range(4) AS q(slot) WHERE is_park = 'yes') SELECT cast(slot AS INTEGER) AS slot, h <> '' AS tagged, open, count(*) AS streets, count(DISTINCT h) AS strings FROM o GROUP BY 1, 2, 3",
    "a22_live_status": "SELECT event_type, count(DISTINCT user_id) AS edge_count, regexp_replace(cast(max(ts) AS VARCHAR), '[.]?0+$', '') AS last_update FROM events GROUP BY 1",
    "a24_height_deltas": net.SQL + "SELECT type, cast(floor(quantile_cont(abs(rise_cm), 0.5) * 2 + 0.5) AS BIGINT) AS median_half, sum(abs(rise_cm))::BIGINT // count(*) AS mean, max(abs(rise_cm)) AS most FROM edges GROUP BY 1",
    "a20_distance_effects": "SELECT o_orderkey % 13 AS weight, max(o_orderkey * 7919 % 9001) AS most, coalesce(max(o_orderkey * 7919 % 9001) FILTER (WHERE o_orderkey % 5 <> 0), 0) AS most_shipped, count(*) AS routes FROM orders GROUP BY 1",
    "a21_consequences": "SELECT * FROM (SELECT o_orderkey % 13 AS weight, CASE WHEN o_orderkey * 31 % 100 >= 80 THEN 'detour' WHEN o_orderkey * 17 % 9 >= 6 THEN 'danger' WHEN o_orderkey * 31 % 100 >= 50 AND o_orderkey * 17 % 9 >= 3 THEN 'both' ELSE 'none' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2) WHERE kind <> 'none'",
    "s22_not_cached": net.SQL + "SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1) // 50 AS batch FROM nodes WHERE node_id % 3 <> 0",
    "f03_clean_places": "SELECT o_orderkey AS collision_id, o_orderkey % 70 AS district, o_orderkey * 7919 % 50000 AS lon, o_orderkey * 104729 % 50000 AS lat FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 70 BETWEEN 1 AND 32 OR o_orderkey % 70 = 57)",
    "u01_layers": net.SQL + "SELECT way_id, 'calming' AS layer, calming AS value, NULL::INTEGER AS cluster FROM ways WHERE calming <> '' UNION ALL SELECT way_id, 'calming', calming_point, NULL FROM ways WHERE calming_point <> '' UNION ALL SELECT way_id, 'barrier', barrier, 3 FROM ways WHERE barrier IN ('gate', 'cycle_barrier', 'mystery')",
    "a02_tag_coverage": _LONG + f" SELECT tag, count(*) FILTER (WHERE NOT {_GONE}) AS filled, count(*) AS total, count(*) FILTER (WHERE NOT {_GONE}) * 1000 // count(*) AS permille FROM tall GROUP BY tag",
    "a03_value_distribution": _LONG + f", v AS (SELECT tag, value, count(*) AS n FROM tall WHERE NOT {_GONE} GROUP BY 1, 2) SELECT tag, value, n, cast(row_number() OVER (PARTITION BY tag ORDER BY n DESC, value) AS INTEGER) AS rank, n * 1000 // sum(n) OVER (PARTITION BY tag)::BIGINT AS permille, count(*) OVER (PARTITION BY tag) AS distinct_n FROM v QUALIFY rank <= 20",
    "a04_risk_summary": net.SQL + "SELECT count(*) FILTER (WHERE risk_milli > 0) AS with_risk, min(risk_milli) FILTER (WHERE risk_milli > 0) AS least, max(risk_milli) AS most, sum(risk_milli)::BIGINT // count(*) FILTER (WHERE risk_milli > 0) AS mean, min(risk_milli) AS floor FROM ways",
    "a06_confidence_bands": net.SQL + "SELECT CASE WHEN conf_tenths <= 0 THEN 'none' WHEN conf_tenths < 5 THEN 'low' WHEN conf_tenths < 10 THEN 'high' ELSE 'full' END AS band, count(*) AS n FROM ways WHERE barrier <> '' GROUP BY 1",
    "a07_elevation_metrics": net.SQL + "SELECT sum(greatest(rise_cm, 0))::BIGINT AS ascent_cm, count(*) FILTER (WHERE grade > 0.033::DOUBLE) AS steep, sum(length_mm)::BIGINT AS length_mm, count(*) FILTER (WHERE grade > 0.001::DOUBLE) AS up, count(*) FILTER (WHERE grade < -0.001::DOUBLE) AS down, count(*) FILTER (WHERE abs(grade) <= 0.001::DOUBLE) AS flat FROM edges",
    "a14_hours_catalog": net.SQL + "SELECT DISTINCT trim(h) AS hours FROM ways, unnest(string_split(opening_hours, ';')) AS q(h) WHERE trim(h) <> ''",
    "u04_undirected_pairs": net.SQL + "SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM edges",
    "t02_tiered_fill": net.SQL + spatial._STREETS + ", r AS (SELECT s.way_id, CASE WHEN surface = 'cobblestone' THEN 0 ELSE 1 END AS tier, (ux + vx + 160000) ** 2 + (uy + vy - 103040000) ** 2 AS d FROM streets s JOIN ways USING (way_id)) SELECT way_id, tier, CASE WHEN tier = 0 THEN 0 ELSE d END AS d2 FROM r ORDER BY tier, d2, way_id LIMIT 20000",
    "w16_hire_stations": net.SQL + spatial._pts("pts", "customer", "c_custkey", 500) + spatial._pts("st", "supplier", "s_suppkey", 500) + ", near AS (SELECT p.id, s.id AS station, s.id % 3 AS bikes, (p.px - s.px) * (p.px - s.px) + (p.py - s.py) * (p.py - s.py) AS d2 FROM pts p JOIN st s ON abs(p.px - s.px) <= 3000 AND abs(p.py - s.py) <= 3000), run AS (SELECT *, coalesce(sum(CASE WHEN bikes > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY d2, station ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM near WHERE d2 <= 9000000) SELECT id, station, d2, bikes FROM run WHERE c < 3",
}
