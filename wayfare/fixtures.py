"""A street network derived from the driver's tables, for tests and benchmarks.

Parts lie on a grid; each gives a street to the east and one to the south. All
measures are integers (millimetres, microdegrees, centimetres), so that any
engine computes the same values. SQL gives the same tables in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: attribute -> (values, index into them); k numbers the streets, {d} is integer division
WAY_TAGS = {
    "type": (["residential", "primary", "cycleway", "footway", "secondary", "tertiary", "service", "motorway", "steps", "unclassified", "path", "trunk"], "k"),
    "oneway": (["no", "yes", "", "-1", "no", "true"], "k {d} 3"),
    "oneway_bicycle": (["", "", "no", ""], "k {d} 5"),
    "bicycle": (["", "yes", "", "designated", "no", "", "permissive"], "k {d} 4"),
    "access": (["", "private", "yes", "customers", "no"], "k {d} 2"),
    "service": (["", "alley", "driveway"], "k {d} 7"),
    "maxspeed": (["20 mph", "30", "", "30 mph", "50", "none", "40 mph", "signals"], "k {d} 4"),
    "surface": (["asphalt", "gravel", "", "cobblestone", "paved", "Dirt", "sett"], "k {d} 3"),
    "lit": (["yes", "no", "", "24/7", "ON"], "k"),
    "width": (["2.5", "3,5", "10 ft", "", "1.2", "wide"], "k {d} 6"),
    "cycleway_width": (["", "", "1,8", ""], "k {d} 9"),
    "cycleway": (["", "lane", "track", "no", "share_busway", "shared_lane", "separate;lane", ""], "k {d} 5"),
    "cycleway_left": (["", "", "no", "lane", "track"], "k {d} 8"),
    "cycleway_lane": (["", "exclusive", "advisory"], "k {d} 2"),
    "separation": (["", "", "kerb", "none", "bollard", ""], "k {d} 11"),
    "calming": (["", "hump", "cushion", "", "choker"], "k {d} 9"),
    "calming_point": (["", "", "table"], "k {d} 10"),
    "barrier": (["", "gate", "bollard", "", "stile", "cycle_barrier", "lift_gate", "", "log", "mystery", "", "kissing_gate"], "k {d} 8"),
    "barrier_access": (["", "private", "yes", "no"], "k {d} 13"),
    "barrier_bicycle": (["", "yes", ""], "k {d} 6"),
    "is_park": (["", "yes", "", ""], "k {d} 10"),
    "is_river": (["", "", "", "", "yes"], "k {d} 14"),
    "programme": (["", "superhighway", "", "quietway;cycleway", "superhighway;quietway"], "k {d} 12"),
    "name": (["Mill Lane", "", "High Street", "Park Road", "nan", "Church Walk"], "k {d} 6"),
    "opening_hours": (["", "24/7", "Mo-Su 06:00-20:00; dawn-dusk", "dawn-dusk"], "k {d} 17"),
}
NODE_TAGS = {
    "crossing": (["", "zebra", "", "uncontrolled", "unmarked"], "node_id * 3 + p_size"),
    "signals": (["", "", "yes", ""], "node_id {d} 2 + p_size"),
    "mini": (["", "yes", "", "", "", "true", ""], "node_id + p_size"),
}


def _pick_sql(values: list[str], index: str) -> str:
    return "([" + ", ".join("'" + v + "'" for v in values) + f"])[({index.format(d='//')}) % {len(values)} + 1]"


def _pick(values: list[str], index: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(pmod({index.format(d='div')}, {len(values)}) + 1 as int)"))


#: CTEs nodes, ways and edges for DuckDB; a query goes on with ", name AS (...)" or SELECT.
SQL = (
    "WITH grid AS (SELECT cast(ceil(sqrt(count(*))) AS bigint) AS w, count(*) AS n FROM part), "
    "nodes AS (SELECT p_partkey AS node_id, p_partkey % w AS gx, p_partkey // w AS gy, -100000 + (p_partkey % w) * 1000 AS x_u, "
    "51500000 + (p_partkey // w) * 1000 AS y_u, (p_partkey * 7919 + p_size * 131) % 6000 AS elev_cm, p_size, w, n FROM part, grid), "
    "tagged_nodes AS (SELECT node_id, gx, gy, x_u, y_u, elev_cm, "
    + ", ".join(f"{_pick_sql(v, i)} AS {c}" for c, (v, i) in NODE_TAGS.items())
    + " FROM nodes), both_ways AS (SELECT node_id AS u, node_id + 1 AS v, node_id * 2 AS way_id, node_id * 2 + p_size AS k, 69000 + ((node_id * 2 + p_size) * 37) % 2000 AS length_mm FROM nodes WHERE gx + 1 < w AND node_id + 1 < n "
    "UNION ALL SELECT node_id, node_id + w, node_id * 2 + 1, node_id * 2 + 1 + p_size, 111000 + ((node_id * 2 + 1 + p_size) * 53) % 2000 FROM nodes WHERE node_id + w < n), "
    "ways AS (SELECT u, v, way_id, k, length_mm, (k % 9) * 250 AS risk_milli, (k % 11) AS conf_tenths, "
    + ", ".join(f"{_pick_sql(v, i)} AS {c}" for c, (v, i) in WAY_TAGS.items())
    + " FROM both_ways), open_ways AS (SELECT * FROM ways WHERE bicycle <> 'no' AND (type <> 'motorway' OR bicycle IN ('yes', 'designated', 'permissive'))), "
    "directed AS (SELECT *, 0 AS back FROM open_ways WHERE oneway <> '-1' OR oneway_bicycle = 'no' UNION ALL SELECT * REPLACE (v AS u, u AS v), 1 FROM open_ways WHERE oneway NOT IN ('yes', 'true', '1') OR oneway_bicycle = 'no'), "
    "edges AS (SELECT d.*, b.elev_cm - a.elev_cm AS rise_cm, (b.elev_cm - a.elev_cm) * 10.0::DOUBLE / d.length_mm AS grade, a.x_u AS ux, a.y_u AS uy, b.x_u AS vx, b.y_u AS vy FROM directed d JOIN nodes a ON a.node_id = d.u JOIN nodes b ON b.node_id = d.v) "
)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, gx, gy, x_u, y_u, elev_cm and node tags."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    w = _width(part)
    base = part.select(F.col("p_partkey").alias("node_id"), F.col("p_size").cast("long").alias("p_size"))
    base = base.withColumns({"gx": F.expr(f"node_id % {w}"), "gy": F.expr(f"node_id div {w}")})
    base = base.withColumns({"x_u": F.expr("-100000 + gx * 1000"), "y_u": F.expr("51500000 + gy * 1000"), "elev_cm": F.expr("(node_id * 7919 + p_size * 131) % 6000")})
    return base.withColumns({c: _pick(v, i) for c, (v, i) in NODE_TAGS.items()}).drop("p_size")


def _width(part: DataFrame) -> int:
    n = part.count()
    w = int(n**0.5)
    return w if w * w == n else w + 1


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected streets with their tags: two for each grid point where the neighbour exists."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    w, n = _width(part), part.count()
    base = part.select(F.col("p_partkey").alias("u"), F.col("p_size").cast("long").alias("p_size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("south"))
    base = base.withColumn("v", F.expr(f"u + if(south = 1, {w}, 1)")).filter(f"v < {n} AND (south = 1 OR u % {w} + 1 < {w})")
    base = base.withColumns({"way_id": F.expr("u * 2 + south"), "k": F.expr("u * 2 + south + p_size")})
    base = base.withColumn("length_mm", F.expr("if(south = 1, 111000 + (k * 53) % 2000, 69000 + (k * 37) % 2000)"))
    base = base.withColumns({"risk_milli": F.expr("(k % 9) * 250"), "conf_tenths": F.expr("k % 11")})
    return base.withColumns({c: _pick(v, i) for c, (v, i) in WAY_TAGS.items()}).drop("p_size", "south")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges after access and direction rules, with rise, grade and end points."""
    from wayfare.operators.graph import directed_edges

    out = directed_edges(ways(spark, sf_dir))
    at = nodes(spark, sf_dir).select("node_id", "x_u", "y_u", "elev_cm")
    a = at.select(F.col("node_id").alias("u"), F.col("x_u").alias("ux"), F.col("y_u").alias("uy"), F.col("elev_cm").alias("_ue"))
    b = at.select(F.col("node_id").alias("v"), F.col("x_u").alias("vx"), F.col("y_u").alias("vy"), F.col("elev_cm").alias("_ve"))
    out = out.join(a, "u").join(b, "v").withColumn("rise_cm", F.expr("_ve - _ue"))
    return out.withColumn("grade", F.expr("rise_cm * 10e0 / length_mm")).drop("_ue", "_ve")
