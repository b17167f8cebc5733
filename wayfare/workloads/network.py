"""Queries over the street network: directions, tags, penalties and edge costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import fixtures as net
from wayfare.functions import tags as t
from wayfare.operators import graph
from wayfare.operators.components import components
from wayfare.plans import cost

#: Fixed request of the cost queries.
WEIGHTS = {"risk_weight": 0.5, "light_weight": 0.5, "surface_weight": 1.0, "speed_weight": 1.0, "tfl_cycleway_weight": 1.0, "green_weight": 0.5, "vehicular_free_weight": 1.5, "junction_weight": 1.0, "signal_weight": 0.5, "barrier_weight": 1.0, "calming_weight": 1.0, "hill_weight": 0.5}
STEEP = 0.4


def milli(c, scale: float = 1000.0):
    """A double as a whole number of thousandths, rounded the same in any engine."""
    return F.floor(c * scale + 0.5).cast("bigint")


def directed(spark: SparkSession, sf: str) -> DataFrame:
    return net.edges(spark, sf).select("u", "v", "way_id", "back", "length_mm", "type", "rise_cm")


def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Edges re-added with other attributes: the later row of a pair (u, v) stands."""
    e = net.edges(spark, sf).select("u", "v", "way_id", "length_mm")
    again = e.filter("length_mm % 2 = 1").withColumn("length_mm", F.col("length_mm") + 500)
    rows = e.withColumn("pass", F.lit(0)).unionByName(again.withColumn("pass", F.lit(1)))
    return graph.last_wins(rows, [F.col("pass"), F.col("way_id")]).select("u", "v", "way_id", "length_mm", "pass")


def reverse_barriers(spark: SparkSession, sf: str) -> DataFrame:
    e = net.edges(spark, sf)
    return graph.with_reverse(e.filter("barrier <> ''").select("u", "v", "barrier", "conf_tenths"), e)


def car_roads(spark: SparkSession, sf: str) -> DataFrame:
    roads = graph.car_roads(net.edges(spark, sf), t.NO_CARS)
    at = net.nodes(spark, sf).join(roads, "node_id", "left").withColumn("roads", F.coalesce("roads", F.lit(0)))
    return at.select("node_id", "roads", F.when((F.col("roads") >= 4) & (F.col("signals") != "yes"), 8).otherwise(0).alias("danger_m"))


def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the paths without cars, and whether a node lies in the largest (ties: the least label)."""
    links = net.ways(spark, sf).filter(F.col("type").isin(*t.VEHICLE_FREE_TYPES))
    found = components(links, "u", "v")
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    top = size.orderBy(F.desc("size"), "component").limit(1).select("component", F.lit(True).alias("largest"))
    return found.join(size, "component").join(F.broadcast(top), "component", "left").select("node", "component", "size", F.coalesce("largest", F.lit(False)).alias("largest"))


def hill_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Steep climbs are grouped where they share a node: under 50 m flat, under 100 m halved."""
    e = net.edges(spark, sf).select("u", "v", "length_mm", "rise_cm", "grade")
    steep = e.filter(F.col("grade") > STEEP)
    label = components(steep, "u", "v").select(F.col("node").alias("u"), "component")
    length = steep.join(label, "u").groupBy("component").agg(F.sum("length_mm").alias("run_mm"))
    marked = e.join(label, "u", "left").join(length, "component", "left")
    keep = F.when((F.col("grade") <= STEEP) | (F.col("run_mm") >= 100_000), F.col("rise_cm") * 2).when(F.col("run_mm") < 50_000, 0).otherwise(F.col("rise_cm"))
    return marked.select("u", "v", F.when(F.col("grade") > STEEP, F.col("run_mm")).alias("run_mm"), keep.cast("bigint").alias("rise_half_cm"))


def csr(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.csr(net.edges(spark, sf).withColumn("cost", F.col("length_mm")))
    return out.select("u", F.size("out").alias("degree"), F.array_join(F.transform("out", lambda x: x["v"].cast("string")), ",").alias("heads"), F.aggregate("out", F.lit(0).cast("bigint"), lambda s, x: s + x["cost"]).alias("total"))


def speed_stress(spark: SparkSession, sf: str) -> DataFrame:
    kmh = t.max_speed_kmh()
    return net.ways(spark, sf).select("way_id", milli(kmh).alias("kmh_milli"), milli(t.speed_stress(kmh)).alias("stress_milli"))


def multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", t.highway_multiplier().cast("int").alias("multiplier"), t.service_denied().alias("denied"))


def widths(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", milli(t.routing_width_m()).alias("width_mm"))


def vehicle_free(spark: SparkSession, sf: str) -> DataFrame:
    mask, reward = t.vf_masks()
    flags = t.vf_flags()
    return net.ways(spark, sf).select("way_id", flags.alias("flags"), (flags.bitwiseAND(F.lit(mask)) != 0).alias("masked"), (flags.bitwiseAND(F.lit(reward)) != 0).alias("rewarded"), t.vehicular_free().alias("vehicle_free"), t.segregated().alias("segregated"))


def barriers(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", t.barrier_cluster().alias("cluster"), t.barrier_hard().alias("hard"), t.barrier_hard("cargo").alias("hard_cargo"), milli(t.barrier_penalty(F.col("conf_tenths") / 10)).alias("penalty_mm"))


def cycleways(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", t.cycleway_cluster().alias("cluster"))


def calming(spark: SparkSession, sf: str) -> DataFrame:
    return net.ways(spark, sf).select("way_id", *[t.calming_m(s).cast("int").alias(s) for s in ("way", "point", "both")])


def hills(spark: SparkSession, sf: str) -> DataFrame:
    return net.edges(spark, sf).select("u", "v", milli(t.hill_m(F.col("length_mm") / 1000, F.col("grade"))).alias("hill_mm"))


def node_penalties(spark: SparkSession, sf: str) -> DataFrame:
    return net.nodes(spark, sf).select("node_id", milli(t.node_crossing_m()).alias("crossing_mm"), milli(t.node_mini_m()).alias("mini_mm"), milli(t.node_signal_m()).alias("signal_mm"))


def edge_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with fastest and optimised cost in millimetres."""
    danger = car_roads(spark, sf).select("node_id", F.col("danger_m").cast("double").alias("v_danger_m"))
    at = net.nodes(spark, sf).select("node_id", t.node_crossing_m().alias("v_crossing_m"), t.node_mini_m().alias("v_mini_m"), t.node_signal_m().alias("v_signal_m")).join(danger, "node_id").withColumnRenamed("node_id", "v")
    return net.edges(spark, sf).join(at, "v").withColumns({"fastest_mm": milli(cost.fastest()), "optimised_mm": milli(cost.optimised(WEIGHTS))})


def fastest_cost(spark: SparkSession, sf: str) -> DataFrame:
    return net.edges(spark, sf).select("u", "v", milli(cost.fastest()).alias("fastest_mm"), milli(cost.fastest("cargo")).alias("cargo_mm"))


def optimised_cost(spark: SparkSession, sf: str) -> DataFrame:
    return edge_costs(spark, sf).select("u", "v", "optimised_mm")


QUERIES = {
    "g01_directed_edges": directed,
    "w01_last_wins": last_wins,
    "j12_reverse_edges": reverse_barriers,
    "a16_car_roads": car_roads,
    "g02_largest_component": largest_component,
    "g03_hill_filter": hill_filter,
    "g10_csr": csr,
    "x13_speed_stress": speed_stress,
    "x15_highway_multiplier": multiplier,
    "x16_routing_width": widths,
    "x17_vehicle_free_flags": vehicle_free,
    "x21_barriers": barriers,
    "x23_cycleway_cluster": cycleways,
    "x25_calming": calming,
    "x12_hill_cost": hills,
    "x24_node_penalties": node_penalties,
    "x28_fastest_cost": fastest_cost,
    "x29_optimised_cost": optimised_cost,
}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _toks(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ';'), lambda x: lower(trim(x))), lambda x: x NOT IN ('', 'no', 'none'))"


def _any(values) -> str:
    listed = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"(list_has_any({_toks('cycleway')}, {listed}) OR list_has_any({_toks('cycleway_left')}, {listed}))"


_DENIED = f"(type = 'service' AND bicycle NOT IN {_in(t.POSITIVE_BICYCLE)} AND access IN {_in(t.SERVICE_DENIED)})"
_MULT = f"(CASE WHEN type = 'steps' THEN 50 WHEN type = 'service' THEN (CASE WHEN {_DENIED} THEN 1 WHEN service = 'alley' THEN 4 ELSE 50 END) WHEN type IN {_in(t.PEDESTRIAN_TYPES)} AND cycleway = '' AND cycleway_left = '' THEN 4 ELSE 1 END)"
_KMH = "(CASE WHEN maxspeed LIKE '%mph%' THEN cast(split_part(maxspeed, ' ', 1) AS DOUBLE) * 1.60934::DOUBLE WHEN maxspeed IN ('30', '50') THEN cast(maxspeed AS DOUBLE) WHEN type IN ('residential', 'unclassified') THEN 30 WHEN type IN ('primary', 'trunk') THEN 50 WHEN type = 'secondary' THEN 48 ELSE 30 END)::DOUBLE"
_STRESS = f"(CASE WHEN {_KMH} - 16 < 20 THEN 0 WHEN {_KMH} - 16 <= 30 THEN 0.15 ELSE 0.35 END)::DOUBLE"
_PARTED = "separation IN ('bollard', 'kerb')"
_SUPER = "list_contains(string_split(programme, ';'), 'superhighway')"
_FREE = f"(type IN {_in(t.VEHICLE_FREE_TYPES)} OR {_any(t.PHYSICAL_CYCLEWAY)} OR {_PARTED} OR {_SUPER})"
_SEGREGATED = f"(is_park <> 'yes' AND (type = 'cycleway' OR {_any(t.PHYSICAL_CYCLEWAY)} OR {_PARTED} OR {_SUPER}))"
_CORE = f"(type = 'cycleway' OR {_any(('track', 'separate', 'exclusive'))} OR {_PARTED} OR {_SUPER})"
_BUS = f"(NOT {_CORE} AND {_any(('share_busway',))})"
_FLAGS = f"((CASE WHEN {_CORE} THEN 1 ELSE 0 END) + (CASE WHEN NOT {_CORE} AND type IN ('path', 'pedestrian', 'footway', 'bridleway') THEN 2 ELSE 0 END) + (CASE WHEN {_BUS} THEN 4 ELSE 0 END) + (CASE WHEN NOT {_CORE} AND NOT {_BUS} AND list_contains({_toks('cycleway')}, 'lane') AND cycleway_lane = 'exclusive' THEN 32 ELSE 0 END) + (CASE WHEN is_park = 'yes' THEN 0 WHEN {_CORE} THEN 8 WHEN {_BUS} THEN 16 ELSE 0 END))"
_CLUSTER = "(CASE WHEN barrier = '' THEN 1 " + " ".join(f"WHEN barrier IN {_in(v)} THEN {k}" for k, v in t.BARRIERS.items()) + " ELSE 3 END)"
_BARRED = f"(barrier_bicycle NOT IN {_in(t.POSITIVE_BICYCLE)} AND barrier_access IN {_in(t.BARRIER_DENIED)})"
_HARD = f"({_BARRED} OR barrier <> '' AND {_CLUSTER} = 5)"
_HARD_CARGO = f"({_BARRED} OR barrier <> '' AND ({_CLUSTER} = 5 OR barrier IN {_in(t.CARGO_BLOCKED)}))"
_BARRIER_M = f"(CASE WHEN {_BARRED} OR barrier = '' THEN 0 ELSE (CASE {_CLUSTER} WHEN 2 THEN 15 WHEN 3 THEN CASE WHEN is_park = 'yes' THEN 0 ELSE 35 END WHEN 4 THEN 90 ELSE 0 END)::DOUBLE * greatest(0, least(1, conf_tenths / 10::DOUBLE)) END)::DOUBLE"
_WIDTH = "(CASE WHEN {c} LIKE '%ft%' THEN try_cast(regexp_replace(replace({c}, ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE) * 0.3048::DOUBLE ELSE try_cast(nullif(regexp_replace(replace({c}, ',', '.'), '[^0-9.]', '', 'g'), '') AS DOUBLE) END)"
_MASKED = f"(type = 'steps' OR type = 'service' AND NOT {_DENIED} AND service <> 'alley')"
_HILL = f"(CASE WHEN {_MASKED} THEN 0 WHEN grade > 0 THEN length_mm / 1000::DOUBLE * (grade * 20 + CASE WHEN grade > 0.033 THEN (grade * 20) * (grade * 20) ELSE 0 END) WHEN grade < -0.033 THEN length_mm / 1000::DOUBLE * 1.5::DOUBLE ELSE 0 END)::DOUBLE"
_CALM = {"way": "(CASE WHEN calming = '' THEN 0 WHEN calming IN ('cushion', 'choker') THEN 5 ELSE 10 END)", "point": "(CASE WHEN calming_point = '' THEN 0 WHEN calming_point IN ('cushion', 'choker') THEN 5 ELSE 10 END)"}
_CALM["both"] = f"greatest({_CALM['way']}, {_CALM['point']})"
_NODE = {"crossing": "(CASE WHEN crossing IN ('zebra', 'uncontrolled') THEN 20 * 16::DOUBLE / 3.6::DOUBLE * 0.5::DOUBLE ELSE 0 END)", "mini": "(CASE WHEN signals = 'yes' THEN 0 WHEN mini IN ('yes', 'true', '1') THEN 20 * 16::DOUBLE / 3.6::DOUBLE * 0.5::DOUBLE ELSE 0 END)", "signal": "(CASE WHEN signals = 'yes' THEN 20 * 16::DOUBLE / 3.6::DOUBLE ELSE 0 END)"}
_ROADS = f"roads AS (SELECT node_id, count(DISTINCT o) AS roads FROM (SELECT u AS node_id, v AS o FROM edges WHERE type NOT IN {_in(t.NO_CARS)} UNION ALL SELECT v, u FROM edges WHERE type NOT IN {_in(t.NO_CARS)}) GROUP BY 1)"
_DANGER = "(CASE WHEN coalesce(roads, 0) >= 4 AND signals <> 'yes' THEN 8 ELSE 0 END)"


def _m(x: str) -> str:
    return f"cast(floor({x} * 1000 + 0.5) AS BIGINT)"


def _optimised_sql() -> str:
    w = WEIGHTS
    mask, rewarded = t.vf_masks()
    free = f"(({_FLAGS} & {mask}) <> 0)"
    d = lambda x: f"{x}::DOUBLE"
    m = f"(1::DOUBLE + CASE WHEN {free} THEN 0::DOUBLE ELSE risk_milli / 1000::DOUBLE * {d(w['risk_weight'])} END + CASE WHEN lower(lit) IN {_in(t.LIT)} THEN 0::DOUBLE ELSE {d(0.5 * w['light_weight'])} END + CASE WHEN NOT {_MASKED} AND lower(surface) IN {_in(t.BAD_SURFACES)} THEN {d(3 * w['surface_weight'])} ELSE 0::DOUBLE END + CASE WHEN {free} THEN 0::DOUBLE ELSE {_STRESS} * {d(w['speed_weight'])} END)"
    r = f"(CASE WHEN programme <> '' THEN {d(cost.reward('tfl_cycleway_weight', 1.0))} ELSE 1 END * CASE WHEN is_park = 'yes' OR is_river = 'yes' THEN {d(cost.reward('green_weight', w['green_weight']))} ELSE 1 END * CASE WHEN ({_FLAGS} & {rewarded}) <> 0 THEN {d(cost.reward('vehicular_free_weight', w['vehicular_free_weight']))} ELSE 1 END)"
    add = f"((crossing_m + mini_m + danger_m) * {d(w['junction_weight'])} + signal_m * {d(w['signal_weight'])} + {_BARRIER_M} * {d(w['barrier_weight'])} + CASE WHEN {free} THEN 0::DOUBLE ELSE {_CALM['both']} * {d(w['calming_weight'])} END + {_HILL} * {d(w['hill_weight'])})"
    total = f"CASE WHEN {_DENIED} OR {_HARD} THEN 1e9::DOUBLE ELSE length_mm / 1000::DOUBLE * greatest(0.1::DOUBLE, {m}) * {_MULT} * greatest(0.1::DOUBLE, {r}) + {add} END"
    at = f"ends AS (SELECT node_id, {_NODE['crossing']}::DOUBLE AS crossing_m, {_NODE['mini']}::DOUBLE AS mini_m, {_NODE['signal']}::DOUBLE AS signal_m, {_DANGER}::DOUBLE AS danger_m FROM tagged_nodes LEFT JOIN roads USING (node_id))"
    return f", {_ROADS}, {at}, costs AS (SELECT edges.*, {_m(total)} AS optimised_mm, {_m(f'CASE WHEN {_DENIED} OR {_HARD} THEN 1e9::DOUBLE ELSE length_mm / 1000::DOUBLE * {_MULT} END')} AS fastest_mm FROM edges JOIN ends ON ends.node_id = edges.v) "


#: DuckDB: the fixture's CTEs and costs (edges with fastest_mm and optimised_mm).
COSTS_SQL = net.SQL + _optimised_sql()
_RECURSIVE = net.SQL.replace("WITH grid", "WITH RECURSIVE grid", 1)


def _labels(links: str) -> str:
    return f", links AS ({links}), pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a, a AS b FROM pairs UNION SELECT r.a, x.b FROM reach r JOIN pairs x ON x.a = r.b), label AS (SELECT b AS node, min(a) AS component FROM reach GROUP BY b)"


ORACLE_SQL = {
    "g01_directed_edges": net.SQL + "SELECT u, v, way_id, back, length_mm, type, rise_cm FROM edges",
    "w01_last_wins": net.SQL + "SELECT u, v, way_id, CASE WHEN length_mm % 2 = 1 THEN length_mm + 500 ELSE length_mm END AS length_mm, cast(length_mm % 2 AS INTEGER) AS pass FROM edges",
    "j12_reverse_edges": net.SQL + "SELECT u, v, barrier, conf_tenths FROM edges WHERE barrier <> '' UNION SELECT e.v, e.u, e.barrier, e.conf_tenths FROM edges e JOIN edges o ON o.u = e.v AND o.v = e.u WHERE e.barrier <> ''",
    "a16_car_roads": net.SQL + f", {_ROADS} SELECT node_id, coalesce(roads, 0) AS roads, {_DANGER} AS danger_m FROM tagged_nodes LEFT JOIN roads USING (node_id)",
    "g02_largest_component": _RECURSIVE + _labels(f"SELECT u AS a, v AS b FROM ways WHERE type IN {_in(t.VEHICLE_FREE_TYPES)}") + ", size AS (SELECT component, count(*) AS size FROM label GROUP BY 1) SELECT node, component, size, component = (SELECT component FROM size ORDER BY size DESC, component LIMIT 1) AS largest FROM label JOIN size USING (component)",
    "g03_hill_filter": _RECURSIVE + _labels(f"SELECT u AS a, v AS b FROM edges WHERE grade > {STEEP}::DOUBLE") + f", run AS (SELECT component, sum(length_mm)::BIGINT AS mm FROM edges JOIN label ON node = u WHERE grade > {STEEP}::DOUBLE GROUP BY 1) SELECT u, v, CASE WHEN grade > {STEEP}::DOUBLE THEN mm END AS run_mm, cast(CASE WHEN grade <= {STEEP}::DOUBLE OR mm >= 100000 THEN rise_cm * 2 WHEN mm < 50000 THEN 0 ELSE rise_cm END AS BIGINT) AS rise_half_cm FROM edges LEFT JOIN label ON node = u LEFT JOIN run USING (component)",
    "g10_csr": net.SQL + "SELECT u, cast(count(*) AS INTEGER) AS degree, string_agg(cast(v AS VARCHAR), ',' ORDER BY v, length_mm) AS heads, sum(length_mm)::BIGINT AS total FROM edges GROUP BY u",
    "x13_speed_stress": net.SQL + f"SELECT way_id, {_m(_KMH)} AS kmh_milli, {_m(_STRESS)} AS stress_milli FROM ways",
    "x15_highway_multiplier": net.SQL + f"SELECT way_id, {_MULT} AS multiplier, {_DENIED} AS denied FROM ways",
    "x16_routing_width": net.SQL + f"SELECT way_id, {_m('CASE WHEN cycleway_width <> ' + chr(39) * 2 + ' THEN ' + _WIDTH.format(c='cycleway_width') + f' WHEN {_FREE} THEN NULL ELSE ' + _WIDTH.format(c='width') + ' END')} AS width_mm FROM ways",
    "x17_vehicle_free_flags": net.SQL + f"SELECT way_id, {_FLAGS} AS flags, ({_FLAGS} & {t.vf_masks()[0]}) <> 0 AS masked, ({_FLAGS} & {t.vf_masks()[1]}) <> 0 AS rewarded, {_FREE} AS vehicle_free, {_SEGREGATED} AS segregated FROM ways",
    "x21_barriers": net.SQL + f"SELECT way_id, {_CLUSTER} AS cluster, {_HARD} AS hard, {_HARD_CARGO} AS hard_cargo, {_m(_BARRIER_M)} AS penalty_mm FROM ways",
    "x23_cycleway_cluster": net.SQL + "SELECT way_id, least(CASE WHEN type = 'cycleway' THEN 1 END, " + ", ".join("CASE " + " ".join(f"WHEN {c} IN {_in(v)} THEN {k}" for k, v in t.CYCLEWAYS.items()) + " END" for c in ("cycleway", "cycleway_left")) + ") AS cluster FROM ways",
    "x25_calming": net.SQL + "SELECT way_id, " + ", ".join(f"{v} AS {k}" for k, v in _CALM.items()) + " FROM ways",
    "x12_hill_cost": net.SQL + f"SELECT u, v, {_m(_HILL)} AS hill_mm FROM edges",
    "x24_node_penalties": net.SQL + "SELECT node_id, " + ", ".join(f"{_m(v)} AS {k}_mm" for k, v in _NODE.items()) + " FROM tagged_nodes",
    "x28_fastest_cost": net.SQL + "SELECT u, v, " + ", ".join(f"{_m(f'CASE WHEN {_DENIED} OR {h} THEN 1e9::DOUBLE ELSE length_mm / 1000::DOUBLE * {_MULT} END')} AS {k}_mm" for k, h in (("fastest", _HARD), ("cargo", _HARD_CARGO))) + " FROM edges",
    "x29_optimised_cost": COSTS_SQL + "SELECT u, v, optimised_mm FROM costs",
}
