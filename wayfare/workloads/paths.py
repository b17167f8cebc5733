"""Queries over routes: search, statistics, runs, profiles and legs.

Tracks are the grid's rows and columns: path_id is the row, or a million and the
column; seq is the place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions import tags as t
from wayfare.functions.text import ride_minutes
from wayfare.operators import runs
from wayfare.operators.overlay import overlay_paths
from wayfare.plans.cost import per_metre_bound as cost_bound
from wayfare.session import settle
from wayfare.workloads import network as n


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    across = F.col("way_id") % 2 == 0
    at = net.nodes(spark, sf).select(F.col("node_id").alias("u"), "gx", "gy", "elev_cm")
    t = net.ways(spark, sf).join(at, "u")
    return t.withColumns({"seq": F.when(across, F.col("gx")).otherwise(F.col("gy")), "path_id": F.when(across, F.col("gy")).otherwise(F.col("gx") + 1_000_000)}).drop("gx", "gy")


def _placed(requests: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """requests with the places of source and target."""
    at = net.nodes(spark, sf).select("node_id", "x_u", "y_u")
    return requests.join(at.toDF("source", "sx", "sy"), "source").join(at.toDF("target", "tx", "ty"), "target")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A stated set of twelve requests, short and long; some have no path."""
    last = net.nodes(spark, sf).agg(F.max("node_id").alias("m"))
    r = last.select("m", F.explode(F.expr("sequence(0L, 11L)")).alias("request_id"))
    return _placed(r.select("request_id", F.expr("request_id * 211 % (m + 1)").alias("source"), F.expr("if(request_id = 11, request_id * 211, request_id * request_id * 97 + 31 * request_id + m div 3) % (m + 1)").alias("target")), spark, sf)


def costs(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return n.edge_costs(spark, sf).select("u", "v", F.col(kind).alias("cost"), "ux", "uy", "vx", "vy", "length_mm")


def totals(requests: DataFrame, spark: SparkSession, sf: str, kind: str, slack: float = 0.0) -> DataFrame:
    """request_id, total: what the cheapest path of each request costs."""
    return overlay_paths(requests, costs(spark, sf, kind), least=LEAST[kind], slack=slack, expand=False)


def fastest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return totals(requests(spark, sf), spark, sf, "fastest_mm")


def optimised_paths(spark: SparkSession, sf: str) -> DataFrame:
    return totals(requests(spark, sf), spark, sf, "optimised_mm")


#: Millimetres that a microdegree measures at least, on this grid; with the least cost of a metre it bounds any path's cost from below.
MM_A_MICRODEGREE = 69
LEAST = {"fastest_mm": MM_A_MICRODEGREE, "optimised_mm": cost_bound(n.WEIGHTS) * MM_A_MICRODEGREE}


def bounded_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The search with a slack of 0.75: its cost against the exact one, and whether the bound holds."""
    r = requests(spark, sf)
    exact = totals(r, spark, sf, "optimised_mm").withColumnRenamed("total", "exact")
    loose = totals(r, spark, sf, "optimised_mm", slack=0.75)
    return exact.join(loose, "request_id").select("request_id", "exact", F.coalesce((F.col("total") >= F.col("exact")) & (F.col("total") * 100 <= F.col("exact") * 175), F.lit(True)).alias("within"))


#: Breaks ties between paths of one cost: the cost times this, and a number of the street below it.
TIES = 1 << 18
#: What a street costs here that is closed to riders: more than any other, and few enough digits for the ties.
BLOCKED = 10**9


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """request_id, seq, u, v, way_id, length_mm: the edges of each request's optimised path, the one of least street numbers among those as cheap."""
    e = n.edge_costs(spark, sf).select("u", "v", "way_id", "length_mm", F.expr(f"least(optimised_mm, {BLOCKED}) * {TIES} + way_id * 7919 % 509").alias("cost"), "ux", "uy", "vx", "vy")
    found = settle(overlay_paths(requests(spark, sf), e, least=LEAST["optimised_mm"] * TIES).filter("seq IS NOT NULL"))
    # the routes' streets are few; all others stay where they are read
    used = e.join(F.broadcast(found.select("u", "v").distinct()), ["u", "v"], "left_semi")
    return settle(found.join(used.groupBy("u", "v").agg(F.min_by(F.struct("way_id", "length_mm"), "cost").alias("e")), ["u", "v"]).select("request_id", "seq", "u", "v", "e.*"))


def route_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What a ride along each found route is like."""
    r, ways = routes(spark, sf), net.ways(spark, sf).drop("u", "v", "length_mm")
    at = net.nodes(spark, sf).select(F.col("node_id").alias("u"), "elev_cm")
    rows = at.join(ways.join(F.broadcast(r), "way_id"), "u").withColumnRenamed("request_id", "path_id")
    return _stats(rows, spark, sf).withColumnRenamed("path_id", "request_id")


def disruption_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of each found route under live records: neighbours of one kind are one run, with its length and worst severity."""
    from wayfare.workloads.live import merged

    live = merged(spark, sf).select(F.col("street").alias("way_id"), "severity", F.when(F.col("closed"), "closure").when(F.col("diversion"), "diversion").otherwise("notice").alias("kind"))
    rows = routes(spark, sf).join(live, "way_id").withColumnRenamed("request_id", "path_id")
    out = runs.collapse_runs(rows, "path_id", "seq", "kind", ["length_mm"])
    worst = rows.select("path_id", "seq", "severity")
    spans = out.select("path_id", "run", F.explode(F.sequence("first_seq", "last_seq")).alias("seq")).join(worst, ["path_id", "seq"]).groupBy("path_id", "run").agg(F.max("severity").alias("severity"))
    return out.join(spans, ["path_id", "run"]).select(F.col("path_id").alias("request_id"), "run", "first_seq", "last_seq", "kind", "length_mm", "severity")


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """Five requests with up to three points on the way, as legs."""
    last = net.nodes(spark, sf).agg(F.max("node_id").alias("m"))
    r = last.select("m", F.explode(F.expr("sequence(0L, 4L)")).alias("trip"))
    r = r.select("trip", F.expr("transform(sequence(0, cast(trip % 4 as int) + 1), i -> (trip * 131 + i * i * 83 + m div 4) % (m + 1))").alias("stops"))
    leg = F.expr("transform(slice(stops, 1, size(stops) - 1), (x, i) -> struct(i AS leg, x AS source, stops[i + 1] AS target))")
    out = r.select("trip", F.explode(leg).alias("l")).select("trip", "l.*")
    return _placed(out.withColumn("request_id", F.expr("trip * 10 + leg")), spark, sf)


def compared(spark: SparkSession, sf: str) -> DataFrame:
    """Each trip's fastest and optimised route over its legs: cost, number of legs and whether all have a path."""
    r, out = legs(spark, sf), None
    for kind in ("fastest_mm", "optimised_mm"):
        each = totals(r, spark, sf, kind)
        one = each.groupBy((F.col("request_id") / 10).cast("bigint").alias("trip")).agg(F.lit(kind[:-3]).alias("mode"), F.when(F.count("total") == F.count("*"), F.sum("total")).alias("cost_mm"), F.count("*").alias("legs"))
        out = one if out is None else out.unionByName(one)
    return out


def path_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What a ride along each track is like."""
    return _stats(tracks(spark, sf), spark, sf)


def _stats(tracks: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Of rows (path_id, and a street from u to v with its tags): lengths by kind in millimetres, counts, minutes and rounded shares."""
    from wayfare.workloads.live import merged

    free, steps, mm = t.vehicular_free(), t.masks_surface_and_hill(), F.col("length_mm")
    share = lambda c: F.sum(F.when(c, mm).otherwise(0))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    programmes = F.split("programme", ";")
    # what the far end and the live records add
    ends = net.nodes(spark, sf).select(F.col("node_id").alias("v"), F.col("elev_cm").alias("v_elev"), (t.node_signal_m() > 0).alias("v_signal"), ((t.node_crossing_m() > 0) | (t.node_mini_m() > 0)).alias("v_stop"))
    danger = n.car_roads(spark, sf).select(F.col("node_id").alias("v"), (F.col("danger_m") > 0).alias("v_danger"))
    live = merged(spark, sf).select(F.col("street").alias("way_id"), F.lit(True).alias("live"))
    rows = tracks.join(ends, "v").join(danger, "v").join(live, "way_id", "left")
    rise = F.col("v_elev") - F.col("elev_cm")
    grade = rise * 10e0 / mm
    out = rows.groupBy("path_id").agg(
        F.sum("length_mm").alias("length_mm"),
        F.sum(F.when(free, 0).otherwise(F.col("risk_milli"))).alias("risk_milli"),
        share(t.is_lit()).alias("lit_mm"),
        share(~steps & t.rough()).alias("rough_mm"),
        F.sum(F.when(~steps & (rise > 0), rise).otherwise(0)).alias("climb_cm"),
        count(~steps & ((grade > t.UP) | (grade < t.DOWN))).alias("steep"),
        share(free).alias("free_mm"),
        share(t.yes("is_park") | t.yes("is_river")).alias("green_mm"),
        share(~free & (t.speed_stress(t.max_speed_kmh()) > 0)).alias("stress_mm"),
        share(F.array_contains(programmes, "quietway")).alias("quiet_mm"),
        share(F.array_contains(programmes, "cycleway") | F.array_contains(programmes, "superhighway")).alias("cycleway_mm"),
        count(~free & (t.calming_m() > 0)).alias("calming"),
        count(t.barrier_hard() | (t.barrier_penalty(F.col("conf_tenths") / 10) > 0)).alias("barriers"),
        count(t.barrier_penalty(F.col("conf_tenths") / 10) > 0).alias("barrier_penalties"),
        count(F.col("v_signal")).alias("signals"),
        count(F.col("v_stop") | F.col("v_danger")).alias("junctions"),
        count(F.coalesce("live", F.lit(False))).alias("disruptions"),
        n.milli(ride_minutes(F.sum("length_mm") / 1000, F.lit(16.0))).alias("minutes_milli"),
    )
    pct = lambda c: F.bround(F.col(c) * 100 / F.col("length_mm")).cast("bigint").alias(c.replace("_mm", "_pct"))
    return out.select("*", *[pct(c) for c in ("lit_mm", "rough_mm", "free_mm", "green_mm", "stress_mm", "quiet_mm", "cycleway_mm")])


def leg_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Legs (ten tracks each) of a trip: lengths and counts add up, shares come from the legs' rounded shares."""
    shares = ("lit_pct", "rough_pct", "free_pct", "green_pct")
    counts = ("length_mm", "climb_cm", "steep", "calming", "barriers", "signals", "junctions", "disruptions")
    legs = path_stats(spark, sf).withColumn("trip", F.expr("path_id div 10"))
    return legs.groupBy("trip").agg(*[F.sum(c).alias(c) for c in counts], *[F.expr(f"sum(length_mm * {c}) div sum(length_mm)").alias(c) for c in shares])


def surface_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracks(spark, sf).withColumn("kind", F.when(t.rough(), "rough").otherwise("smooth"))
    return runs.collapse_runs(rows.withColumn("mm", F.col("length_mm")), "path_id", "seq", "kind", ["mm"], ["name"]).select("path_id", "run", "first_seq", "last_seq", "kind", "mm", "name")


def green_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracks(spark, sf).filter(t.yes("is_park") | t.yes("is_river")).withColumn("kind", F.when(t.yes("is_park"), "park").otherwise("river"))
    return runs.collapse_runs(rows, "path_id", "seq", "kind", ["length_mm"]).select("path_id", "run", "first_seq", "last_seq", "kind", "length_mm")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return runs.running(tracks(spark, sf), "path_id", "seq", "length_mm", "at_mm").select("path_id", "seq", "at_mm", "elev_cm")


def sampled_profile(spark: SparkSession, sf: str, most: int = 120) -> DataFrame:
    return runs.sample_evenly(profile(spark, sf), "path_id", "seq", most).select("path_id", "sample", "seq", "at_mm")


def stitched(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of ten tracks in a row, with the distance of the tracks before."""
    p = profile(spark, sf).withColumns({"trip": F.expr("path_id div 10"), "place": F.expr("(path_id % 10) * 1000000 + seq")})
    step = p.join(tracks(spark, sf).select("path_id", "seq", "length_mm"), ["path_id", "seq"])
    return runs.running(step, "trip", "place", "length_mm", "trip_mm").select("trip", "place", "trip_mm")


def type_joints(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracks(spark, sf).withColumn("lit_now", t.is_lit().cast("int"))
    return runs.without_joints(rows, "path_id", "seq", "lit_now").select("path_id", "seq", "lit_now")


def mode_shares(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(t.segregated(), "segregated").when(t.vehicular_free(), "shared").otherwise("traffic")
    by = tracks(spark, sf).groupBy("path_id", kind.alias("kind")).agg(F.sum("length_mm").alias("mm"))
    total = by.groupBy("path_id").agg(F.sum("mm").alias("all_mm"))
    return by.join(total, "path_id").select("path_id", "kind", "mm", F.expr("mm * 100 div all_mm").alias("pct"))


QUERIES = {
    "g05_fastest_paths": fastest_paths,
    "g05_optimised_paths": optimised_paths,
    "g08_bounded_paths": bounded_paths,
    "g09_compared_routes": compared,
    "a09_path_stats": path_stats,
    "a09_route_stats": route_stats,
    "w05_disruption_runs": disruption_runs,
    "a10_leg_totals": leg_totals,
    "a11_mode_shares": mode_shares,
    "w04_surface_runs": surface_runs,
    "w05_green_runs": green_runs,
    "w06_profile": profile,
    "w07_sampled_profile": sampled_profile,
    "w08_stitched_profile": stitched,
    "w09_joints": type_joints,
}

_TRACKS = net.SQL + ", tracks AS (SELECT w.*, CASE WHEN way_id % 2 = 0 THEN gx ELSE gy END AS seq, CASE WHEN way_id % 2 = 0 THEN gy ELSE gx + 1000000 END AS path_id, elev_cm FROM ways w JOIN nodes ON node_id = w.u) "
_ROUGH = f"(lower(surface) IN {n._in(t.BAD_SURFACES)})"
_RUNS = "SELECT path_id, run, min(seq) AS first_seq, max(seq) AS last_seq, any_value(kind) AS kind, sum(length_mm)::BIGINT AS {mm}{more} FROM (SELECT *, sum(fresh) OVER (PARTITION BY path_id ORDER BY seq) - 1 AS run FROM (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM kinds WINDOW w AS (PARTITION BY path_id ORDER BY seq))) GROUP BY path_id, run"


_INSIDE = "sqrt(((ax - sx) ** 2 + (ay - sy) ** 2)::DOUBLE) + sqrt(((ax - tx) ** 2 + (ay - ty) ** 2)::DOUBLE) <= sqrt(((tx - sx) ** 2 + (ty - sy) ** 2)::DOUBLE) * 1.5"
_REQUESTS = "SELECT k AS request_id, k * 211 % (m + 1) AS source, (CASE WHEN k = 11 THEN k * 211 ELSE k * k * 97 + 31 * k + m // 3 END) % (m + 1) AS target FROM top, range(12) AS q(k)"
_LEGS = "SELECT trip * 10 + i AS request_id, (trip * 131 + i * i * 83 + m // 4) % (m + 1) AS source, (trip * 131 + (i + 1) * (i + 1) * 83 + m // 4) % (m + 1) AS target FROM top, range(5) AS q(trip), range(4) AS z(i) WHERE i <= trip % 4"


def _paths_sql(kind: str, requests: str = _REQUESTS) -> str:
    """CTEs up to total (request_id, total): least costs over the edges in each request's ellipse; null where there is no path."""
    base = n.COSTS_SQL.replace("WITH grid", "WITH RECURSIVE grid", 1)
    place = lambda x, y: _INSIDE.replace("ax", x).replace("ay", y)
    return base + f", top AS (SELECT max(node_id) AS m FROM nodes), req AS (SELECT q.*, a.x_u AS sx, a.y_u AS sy, b.x_u AS tx, b.y_u AS ty FROM ({requests}) q JOIN nodes a ON a.node_id = q.source JOIN nodes b ON b.node_id = q.target), near AS (SELECT request_id, e.u, e.v, e.{kind} AS c FROM req JOIN costs e ON {place('ux', 'uy')} AND {place('vx', 'vy')}), dist(request_id, node, c) USING KEY (request_id, node) AS (SELECT request_id::BIGINT, source::BIGINT, 0::BIGINT FROM req UNION SELECT d.request_id, e.v, min(d.c + e.c) FROM dist d JOIN near e ON e.u = d.node AND e.request_id = d.request_id LEFT JOIN recurring.dist r ON r.request_id = d.request_id AND r.node = e.v WHERE d.c + e.c < coalesce(r.c, 9000000000000000000) GROUP BY 1, 2), total AS (SELECT req.request_id, d.c AS total FROM req LEFT JOIN dist d ON d.request_id = req.request_id AND d.node = req.target) "


def _routes_sql() -> str:
    """CTEs up to route (request_id, seq, u, v, way_id, length_mm): back from the target over edges that are part of a cheapest path."""
    own = f"least(e.optimised_mm, {BLOCKED}) * {TIES} + e.way_id * 7919 % 509 AS c, e.way_id, e.length_mm"
    return _paths_sql("optimised_mm").replace("e.optimised_mm AS c", own, 1) + """, tight AS MATERIALIZED (SELECT near.request_id, near.u, near.v, way_id, length_mm FROM near JOIN dist x ON x.request_id = near.request_id AND x.node = near.u JOIN dist y ON y.request_id = near.request_id AND y.node = near.v WHERE x.c + near.c = y.c),
back(request_id, u, v, way_id, length_mm, n) AS (SELECT t.*, 0 FROM tight t JOIN req ON req.request_id = t.request_id AND t.v = req.target WHERE req.source <> req.target
  UNION ALL SELECT t.*, back.n + 1 FROM back JOIN tight t ON t.request_id = back.request_id AND t.v = back.u),
route AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY n DESC) - 1 AS seq, u, v, way_id, length_mm FROM back) """


_ROUTE_TRACKS = ", tracks AS (SELECT r.request_id AS path_id, r.seq, r.u, r.v, w.* EXCLUDE (u, v), elev_cm FROM route r JOIN ways w USING (way_id) JOIN nodes ON node_id = r.u) "


def _feed_sql() -> str:
    """CTE mg: the merged records of both feeds."""
    from wayfare.workloads.live import ORACLE_SQL as live

    feed = live["l04_merged_feeds"].replace("WITH e AS", ", e AS", 1)
    at = feed.index(" SELECT coalesce(p.street")
    return f"{feed[:at]}, mg AS ({feed[at:]})"


def _stats_sql(tracks: str = _TRACKS + f", {n._ROADS}") -> str:
    """CTE stats: the columns of path_stats."""
    sum_of = lambda c: f"coalesce(sum(length_mm) FILTER (WHERE {c}), 0)::BIGINT"
    has = lambda x: f"list_contains(string_split(programme, ';'), '{x}')"
    cols = {
        "length_mm": "sum(length_mm)::BIGINT", "risk_milli": f"sum(CASE WHEN {n._FREE} THEN 0 ELSE risk_milli END)::BIGINT", "lit_mm": sum_of(f"lower(lit) IN {n._in(t.LIT)}"), "rough_mm": sum_of(f"NOT {n._MASKED} AND {_ROUGH}"),
        "climb_cm": f"sum(CASE WHEN NOT {n._MASKED} AND rise > 0 THEN rise ELSE 0 END)::BIGINT", "steep": f"count(*) FILTER (WHERE NOT {n._MASKED} AND (rise * 10::DOUBLE / length_mm > 0.033 OR rise * 10::DOUBLE / length_mm < -0.033))",
        "free_mm": sum_of(n._FREE), "green_mm": sum_of("is_park = 'yes' OR is_river = 'yes'"), "stress_mm": sum_of(f"NOT {n._FREE} AND {n._STRESS} > 0"), "quiet_mm": sum_of(has("quietway")), "cycleway_mm": sum_of(f"({has('cycleway')} OR {has('superhighway')})"),
        "calming": f"count(*) FILTER (WHERE NOT {n._FREE} AND {n._CALM['both']} > 0)", "barriers": f"count(*) FILTER (WHERE {n._HARD} OR {n._BARRIER_M} > 0)", "barrier_penalties": f"count(*) FILTER (WHERE {n._BARRIER_M} > 0)",
        "signals": "count(*) FILTER (WHERE sig = 'yes')", "junctions": "count(*) FILTER (WHERE crossing IN ('zebra', 'uncontrolled') OR sig <> 'yes' AND mini IN ('yes', 'true', '1') OR roads >= 4 AND sig <> 'yes')", "disruptions": "count(*) FILTER (WHERE way_id IN (SELECT street FROM mg))",
        "minutes_milli": n._m("(sum(length_mm) / 1000::DOUBLE / (16::DOUBLE / 3.6::DOUBLE * 60))"),
    }
    shares = ", ".join(f"cast(round_even({c} * 100 / length_mm::DOUBLE, 0) AS BIGINT) AS {c.replace('_mm', '_pct')}" for c in ("lit_mm", "rough_mm", "free_mm", "green_mm", "stress_mm", "quiet_mm", "cycleway_mm"))
    # the feed's columns must not hide those of the streets
    rows = "SELECT t.*, x.elev_cm - t.elev_cm AS rise, x.signals AS sig, x.crossing, x.mini, coalesce(roads, 0) AS roads FROM tracks t JOIN tagged_nodes x ON x.node_id = t.v LEFT JOIN roads ON roads.node_id = t.v"
    return tracks + f"{_feed_sql()}, wide AS ({rows}), sums AS (SELECT path_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM wide GROUP BY path_id), stats AS (SELECT *, {shares} FROM sums) "


def _compared_sql() -> str:
    one = lambda kind: _paths_sql(kind, _LEGS) + f"SELECT request_id // 10 AS trip, '{kind[:-3]}' AS mode, CASE WHEN count(total) = count(*) THEN sum(total)::BIGINT END AS cost_mm, count(*) AS legs FROM total GROUP BY 1"
    return f"SELECT * FROM ({one('fastest_mm')}) UNION ALL SELECT * FROM ({one('optimised_mm')})"


ORACLE_SQL = {
    "g05_fastest_paths": _paths_sql("fastest_mm") + "SELECT request_id, total FROM total",
    "g05_optimised_paths": _paths_sql("optimised_mm") + "SELECT request_id, total FROM total",
    "g08_bounded_paths": _paths_sql("optimised_mm") + "SELECT request_id, total AS exact, true AS within FROM total",
    "g09_compared_routes": _compared_sql(),
    "a09_path_stats": _stats_sql() + "SELECT * FROM stats",
    "a09_route_stats": _stats_sql(_routes_sql() + _ROUTE_TRACKS) + "SELECT * RENAME (path_id AS request_id) FROM stats",
    "w05_disruption_runs": _routes_sql() + _feed_sql() + """, live AS (SELECT request_id, seq, length_mm, severity, CASE WHEN closed THEN 'closure' WHEN diversion THEN 'diversion' ELSE 'notice' END AS kind FROM route JOIN mg ON mg.street = route.way_id),
fresh AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM live WINDOW w AS (PARTITION BY request_id ORDER BY seq)), numbered AS (SELECT *, sum(new) OVER (PARTITION BY request_id ORDER BY seq) - 1 AS run FROM fresh)
SELECT request_id, run, min(seq) AS first_seq, max(seq) AS last_seq, any_value(kind) AS kind, sum(length_mm)::BIGINT AS length_mm, max(severity) AS severity FROM numbered GROUP BY request_id, run""",
    "a10_leg_totals": _stats_sql() + "SELECT path_id // 10 AS trip, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("length_mm", "climb_cm", "steep", "calming", "barriers", "signals", "junctions", "disruptions")) + ", " + ", ".join(f"sum(length_mm * {c})::BIGINT // sum(length_mm)::BIGINT AS {c}" for c in ("lit_pct", "rough_pct", "free_pct", "green_pct")) + " FROM stats GROUP BY 1",
    "a11_mode_shares": _TRACKS + f"SELECT path_id, kind, mm, mm * 100 // sum(mm) OVER (PARTITION BY path_id)::BIGINT AS pct FROM (SELECT path_id, CASE WHEN {n._SEGREGATED} THEN 'segregated' WHEN {n._FREE} THEN 'shared' ELSE 'traffic' END AS kind, sum(length_mm)::BIGINT AS mm FROM tracks GROUP BY 1, 2)",
    "w04_surface_runs": _TRACKS + f", kinds AS (SELECT *, CASE WHEN {_ROUGH} THEN 'rough' ELSE 'smooth' END AS kind FROM tracks) " + _RUNS.format(mm="mm", more=", coalesce(arg_min(name, seq) FILTER (WHERE name <> ''), '') AS name"),
    "w05_green_runs": _TRACKS + ", kinds AS (SELECT *, CASE WHEN is_park = 'yes' THEN 'park' ELSE 'river' END AS kind FROM tracks WHERE is_park = 'yes' OR is_river = 'yes') " + _RUNS.format(mm="length_mm", more=""),
    "w06_profile": _TRACKS + "SELECT path_id, seq, sum(length_mm) OVER (PARTITION BY path_id ORDER BY seq)::BIGINT AS at_mm, elev_cm FROM tracks",
    "w07_sampled_profile": _TRACKS + ", ends AS (SELECT path_id, max(seq) AS m FROM tracks GROUP BY 1), picks AS (SELECT path_id, i AS sample, CASE WHEN m < 120 THEN i ELSE cast(round_even(i * (m / 119::DOUBLE), 0) AS BIGINT) END AS seq FROM ends, unnest(range(120)) AS q(i) WHERE i <= m) SELECT path_id, sample, seq, at_mm FROM picks JOIN (SELECT path_id, seq, sum(length_mm) OVER (PARTITION BY path_id ORDER BY seq)::BIGINT AS at_mm FROM tracks) USING (path_id, seq)",
    "w08_stitched_profile": _TRACKS + "SELECT path_id // 10 AS trip, path_id % 10 * 1000000 + seq AS place, sum(length_mm) OVER (PARTITION BY path_id // 10 ORDER BY path_id, seq)::BIGINT AS trip_mm FROM tracks",
    "w09_joints": _TRACKS + f"SELECT path_id, seq, lit_now FROM (SELECT path_id, seq, lit_now, lag(lit_now) OVER (PARTITION BY path_id ORDER BY seq) AS p FROM (SELECT *, CASE WHEN lower(lit) IN {n._in(t.LIT)} THEN 1 ELSE 0 END AS lit_now FROM tracks)) WHERE p IS NULL OR p <> lit_now",
}
