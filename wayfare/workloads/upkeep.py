"""Queries that keep a network up to date: polls that may fail, budgets, tags set anew, parks, masks, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions import tags as t
from wayfare.operators import spatial as op
from wayfare.plans.rules import within_window
from wayfare.session import shared_folder
from wayfare.streaming.polls import last_good_poll
from wayfare.workloads import build, spatial as sp

#: Budgets as (name, seconds, most).
BUDGETS = (("auth_ip", 60, 30), ("email_failures", 900, 5), ("reset_email", 3600, 3), ("reset_ip", 3600, 10), ("signup_ip", 3600, 5), ("sensitive_user", 900, 5), ("geocode_ip", 60, 60), ("route_ip", 60, 5))
#: The events table has a hit of a user every few hours; budgets are checked on a clock that runs so much faster.
FASTER = 400
#: Keys of a profile that a user may write.
WRITABLE = ("name", "weights", "toggles", "bike_type")


def polled(spark: SparkSession, sf: str) -> DataFrame:
    """Three polls of a feed, one after the other; the last one is broken, so what the second brought stays."""
    where = f"{shared_folder(spark)}/polls-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").select("event_id", F.expr("event_id * 31 % 1500").alias("street"))
    for k in range(3):
        rows = e.filter(F.col("event_id") % 3 >= k)
        text = F.lit("<html>busy</html>") if k == 2 else F.to_json(F.struct("event_id", "street"))
        rows.select(text.alias("value")).coalesce(1).write.mode("append").text(f"{where}/in")
    now = last_good_poll(spark, f"{where}/in", where, "event_id long, street long", "event_id")
    return now.groupBy("street").agg(F.count("*").alias("n"), F.max("event_id").alias("event_id"))


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each user under each of the eight budgets: how many lie in its window, and whether that is within it."""
    second = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.floor(second / FASTER).alias("second"))
    out = None
    for name, window, most in BUDGETS:
        one = within_window(e, "user_id", "second", window, most).select("event_id", F.lit(name).alias("budget"), "recent", "allowed")
        out = one if out is None else out.unionByName(one)
    return out


def whitelisted(spark: SparkSession, sf: str) -> DataFrame:
    """Of what a request sends only the keys that it may write, in order."""
    keys = F.array(*map(F.lit, ("name", "is_system", "weights", "user_id", "bike_type")))
    sent = F.map_from_arrays(keys, F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("o_orderkey"))))
    sent = F.map_filter(sent, lambda k, v: (F.length(k) + F.col("o_orderkey")) % 3 != 0)
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(F.map_values(F.map_filter(sent, lambda k, v: k.isin(*WRITABLE)))), ",").alias("kept"))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """What each of the eight sets of toggles lets count as free of cars, and what it rewards."""
    w = net.ways(spark, sf).select("way_id", t.vf_flags().alias("flags"))
    out = None
    for k in range(8):
        mask, reward = t.vf_masks(bool(k & 1), bool(k & 2), bool(k & 4))
        one = w.groupBy(F.lit(k).alias("toggles")).agg(F.sum((F.col("flags").bitwiseAND(F.lit(mask)) != 0).cast("bigint")).alias("masked"), F.sum((F.col("flags").bitwiseAND(F.lit(reward)) != 0).cast("bigint")).alias("rewarded"))
        out = one if out is None else out.unionByName(one)
    return out


def zone_tags(spark: SparkSession, sf: str) -> DataFrame:
    """All streets with the zone tag set anew: what an earlier run left is gone, owners of today carry theirs."""
    own = sp.zone_owner(spark, sf).select("way_id", "zone")
    return net.ways(spark, sf).select("way_id").join(own, "way_id", "left")


def node_signs(spark: SparkSession, sf: str) -> DataFrame:
    """Signs on the nearest node in reach; of several the last one in order counts."""
    at = net.nodes(spark, sf).select("node_id", F.col("x_u").alias("qx"), F.col("y_u").alias("qy"))
    near = op.points_near_points(sp._points(spark, sf, "customer", "c_custkey", 500), at, sp.SNAP).filter(F.col("d2") < sp.SNAP**2)
    best = near.groupBy("id").agg(F.min(F.struct("d2", "node_id")).alias("x")).select("id", "x.node_id")
    return best.groupBy("node_id").agg(F.max("id").alias("sign"), F.count("*").alias("n"))


def way_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Programmes and routes of a street over the records of all its edges, in order of first mention."""
    e = net.edges(spark, sf).select("u", "v", "way_id").distinct()
    r = build._records(spark, sf).filter("NOT removed").select("id", "u", "v", F.lower(F.trim("programme")).alias("p"), F.trim("route").alias("r"))
    x = r.join(e, ["u", "v"]).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("id", "p", "r"))).alias("x"))
    said = lambda c: F.array_join(F.array_distinct(F.filter(F.col(f"x.{c}"), lambda y: y != "")), ";")
    return x.select("way_id", said("p").alias("programme"), said("r").alias("route"))


def parks(spark: SparkSession, sf: str) -> DataFrame:
    """Park areas from a stored table: the box reaches the scan, private ones are left out, of one id the last version stands."""
    where = f"{shared_folder(spark)}/parks-{uuid.uuid4().hex}"
    n = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 400).alias("id"), F.col("c_custkey").alias("version"), F.element_at(F.array(*map(F.lit, ("park", "recreation_ground", "forest"))), F.expr("cast(c_custkey % 3 + 1 as int)")).alias("kind"), F.element_at(F.array(*map(F.lit, ("", "private", "yes", "no"))), F.expr("cast(c_custkey % 4 + 1 as int)")).alias("access"), F.expr("c_custkey * 7919 % 50000").alias("x0"), F.expr("c_custkey * 104729 % 50000").alias("y0"))
    n.withColumns({"x1": F.col("x0") + 900, "y1": F.col("y0") + 700}).write.parquet(where)
    got = spark.read.parquet(where).filter("x1 >= 10000 AND x0 <= 40000 AND y1 >= 5000 AND y0 <= 30000 AND kind IN ('park', 'recreation_ground') AND access NOT IN ('private', 'no')")
    return got.groupBy("id").agg(F.max_by(F.struct("kind", "x0", "y0"), "version").alias("x"), F.max("version").alias("version")).select("id", "version", "x.*")


def accident_places(spark: SparkSession, sf: str) -> DataFrame:
    return sp.collisions(spark, sf).select(F.col("py").alias("lat_u"), F.col("px").alias("lon_u"))


def listed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A user's list of profiles: the system's first, then by name; place counts within each user's list."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") % 50).alias("user_id"), F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("name"), (F.col("c_custkey") % 9 == 0).alias("is_system"))
    w = Window.partitionBy("user_id").orderBy(F.desc("is_system"), "name", "id")
    return c.select("user_id", "id", "name", F.row_number().over(w).alias("place"))


QUERIES = {
    "l03_failed_poll": polled, "r08_budgets": budgets, "f16_whitelisted": whitelisted, "x18_masks": masks, "g17_zone_tags": zone_tags, "g18_node_signs": node_signs,
    "a12_way_tags": way_tags, "s04_parks": parks, "s20_accident_places": accident_places, "t03_listed_profiles": listed_profiles,
}


def _mask_sql() -> str:
    from wayfare.workloads import network as n

    # flags: 1 core, 2 shared path, 4 bus lane, 32 painted lane; 8 and 16 reward the core and the bus lane
    mask = "(1 + CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN k // 2 % 2 = 1 THEN 4 ELSE 0 END + CASE WHEN k // 4 = 1 THEN 32 ELSE 0 END)"
    reward = "(8 + CASE WHEN k // 2 % 2 = 1 THEN 16 ELSE 0 END)"
    return net.SQL + f", f AS (SELECT {n._FLAGS} AS flags FROM ways) SELECT cast(k AS INTEGER) AS toggles, sum((flags & {mask} <> 0)::INTEGER)::BIGINT AS masked, sum((flags & {reward} <> 0)::INTEGER)::BIGINT AS rewarded FROM f, range(8) AS q(k) GROUP BY k"


ORACLE_SQL = {
    "l03_failed_poll": "SELECT event_id * 31 % 1500 AS street, count(*) AS n, max(event_id) AS event_id FROM events WHERE event_type = 'error' AND event_id % 3 >= 1 GROUP BY 1",
    "r08_budgets": "WITH e AS (SELECT event_id, user_id, cast(floor(floor(epoch(ts)) / 400) AS BIGINT) AS s FROM events), b(budget, w, most) AS (VALUES " + ", ".join(f"('{a}', {w}, {m})" for a, w, m in BUDGETS) + ") SELECT a.event_id, budget, count(*) AS recent, count(*) <= most AS allowed FROM e a JOIN b ON true JOIN e o ON o.user_id = a.user_id AND o.s BETWEEN a.s - b.w + 1 AND a.s GROUP BY a.event_id, budget, most",
    "f16_whitelisted": "SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN (9 + o_orderkey) % 3 <> 0 THEN 'bike_type=' || o_orderkey END, CASE WHEN (4 + o_orderkey) % 3 <> 0 THEN 'name=' || o_orderkey END, CASE WHEN (7 + o_orderkey) % 3 <> 0 THEN 'weights=' || o_orderkey END], lambda x: x IS NOT NULL), ',') AS kept FROM orders",
    "x18_masks": _mask_sql(),
    "g17_zone_tags": "SELECT way_id, zone FROM (" + net.SQL + "SELECT way_id FROM ways) LEFT JOIN (" + sp.ORACLE_SQL["j14_zone_owner"] + ") USING (way_id)",
    "g18_node_signs": net.SQL + sp._pts("pts", "customer", "c_custkey", 500) + ", best AS (SELECT id, node_id FROM (SELECT id, node_id, (px - x_u) * (px - x_u) + (py - y_u) * (py - y_u) AS d2 FROM pts, nodes WHERE abs(px - x_u) < 200 AND abs(py - y_u) < 200) WHERE d2 < 40000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, node_id) = 1) SELECT node_id, max(id) AS sign, count(*) AS n FROM best GROUP BY 1",
    "a12_way_tags": net.SQL + ", r AS (SELECT o_orderkey AS id, o_orderkey * 37 % n AS u, o_orderkey * 37 % n + 1 AS v, (['quietway', 'cycleway', '', 'tram', 'superhighway'])[o_orderkey % 5 + 1] AS p, (['C1', '', 'Q7', 'CS3', 'C1', 'C9'])[o_orderkey % 6 + 1] AS q FROM orders, grid WHERE o_orderkey % 4 <> 3), j AS (SELECT DISTINCT way_id, id, p, q FROM r JOIN edges USING (u, v)), w AS (SELECT DISTINCT way_id FROM j) SELECT w.way_id, coalesce((SELECT string_agg(p, ';' ORDER BY f) FROM (SELECT p, min(id) AS f FROM j WHERE j.way_id = w.way_id AND p <> '' GROUP BY p)), '') AS programme, coalesce((SELECT string_agg(q, ';' ORDER BY f) FROM (SELECT q, min(id) AS f FROM j WHERE j.way_id = w.way_id AND q <> '' GROUP BY q)), '') AS route FROM w",
    "s04_parks": "SELECT c_custkey % 400 AS id, c_custkey AS version, (['park', 'recreation_ground', 'forest'])[c_custkey % 3 + 1] AS kind, c_custkey * 7919 % 50000 AS x0, c_custkey * 104729 % 50000 AS y0 FROM customer WHERE c_custkey * 7919 % 50000 BETWEEN 9100 AND 40000 AND c_custkey * 104729 % 50000 BETWEEN 4300 AND 30000 AND c_custkey % 3 < 2 AND c_custkey % 4 IN (0, 2) QUALIFY row_number() OVER (PARTITION BY c_custkey % 400 ORDER BY c_custkey DESC) = 1",
    "s20_accident_places": net.SQL + sp._pts("pts", "orders", "o_orderkey", 600, sp._BIKES) + " SELECT py AS lat_u, px AS lon_u FROM pts",
    "t03_listed_profiles": "SELECT c_custkey % 50 AS user_id, c_custkey AS id, lower(c_mktsegment) AS name, cast(row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey % 9 = 0 DESC, lower(c_mktsegment), c_custkey) AS INTEGER) AS place FROM customer",
}
