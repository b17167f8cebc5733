"""Scans and sinks of feeds and exchange files: disruptions, incidents, polygons, edge tags, tables and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Programme of a route file -> tag on an edge. Other programmes are left out.
PROGRAMMES = {"Cycleways": "cycleway", "Quietways": "quietway", "Cycle Superhighways": "superhighway"}
LINES = "features array<struct<properties:struct<Programme:string,Label:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
POLYGONS = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
DISRUPTIONS = "id string, category string, severity string, status string, startDateTime string, endDateTime string, _corrupt string"
INCIDENTS = "incidents array<struct<properties:struct<id:string,iconCategory:int,magnitudeOfDelay:int>,geometry:struct<type:string,coordinates:array<double>>>>"


def programme_segments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """tag, label, line, seq, ax, ay, bx, by: segments of a route file's lines whose programme is known; lines of one point are left out."""
    f = spark.read.schema(LINES).option("multiLine", multi_line).json(path).select(F.explode("features").alias("f"))
    tag = F.create_map(*[F.lit(x) for kv in PROGRAMMES.items() for x in kv])[F.trim("f.properties.Programme")]
    f = f.filter("f.geometry.type = 'MultiLineString'").withColumn("tag", tag).filter("tag IS NOT NULL")
    line = f.select("tag", F.trim("f.properties.Label").alias("label"), F.posexplode("f.geometry.coordinates").alias("line", "pts")).filter("size(pts) > 1")
    step = line.select("tag", "label", "line", F.posexplode(F.expr("transform(slice(pts, 1, size(pts) - 1), (p, i) -> struct(p AS a, pts[i + 1] AS b))")).alias("seq", "s"))
    return step.select("tag", "label", "line", "seq", *[F.col(f"s.{p}")[i].alias(p + "xy"[i]) for p in ("a", "b") for i in (0, 1)])


def polygon_rings(spark: SparkSession, path: str, name_key: str, multi_line: bool = False) -> DataFrame:
    """name, ring, points (lat, lon), closed: rings of the polygons of a file, flipped to (lat, lon)."""
    f = spark.read.schema(POLYGONS).option("multiLine", multi_line).json(path).select(F.explode("features").alias("f")).filter("f.geometry.type = 'Polygon'")
    ring = f.select(F.col("f.properties")[name_key].alias("name"), F.posexplode("f.geometry.coordinates").alias("ring", "pts"))
    return ring.select("name", "ring", F.transform("pts", lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))).alias("points"), (F.element_at("pts", 1) == F.element_at("pts", -1)).alias("closed"))


def disruptions(spark: SparkSession, path: str) -> DataFrame:
    """A disruption feed of one record a line; lines that aren't records are left out."""
    rows = spark.read.schema(DISRUPTIONS).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("id IS NOT NULL AND _corrupt IS NULL").drop("_corrupt")


def incidents(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Of an incident feed the fields in use, of points inside the box (west, south, east, north)."""
    i = spark.read.schema(INCIDENTS).json(path).select(F.explode("incidents").alias("i"))
    out = i.select("i.properties.id", F.col("i.properties.iconCategory").alias("icon"), F.col("i.properties.magnitudeOfDelay").alias("delay"), F.col("i.geometry.coordinates")[0].alias("lon"), F.col("i.geometry.coordinates")[1].alias("lat"))
    return out.filter(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))


def export_tags(edges: DataFrame, path: str) -> None:
    """Edges that carry a programme or a route, one record a line."""
    tagged = edges.filter("trim(programme) <> '' OR trim(route) <> ''")
    tagged.select(F.col("u").cast("string").alias("source"), F.col("v").cast("string").alias("target"), F.trim("programme").alias("programme"), F.trim("route").alias("route")).write.mode("overwrite").json(path)


def import_tags(edges: DataFrame, path: str) -> DataFrame:
    """edges (u, v, ...) with the exported tags in place of their own; edges that aren't in the export carry none."""
    tags = edges.sparkSession.read.schema("source string, target string, programme string, route string").json(path)
    tags = tags.select(F.col("source").cast("bigint").alias("u"), F.col("target").cast("bigint").alias("v"), "programme", "route")
    own = edges.drop("programme", "route")
    return own.join(tags, ["u", "v"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("programme", "route")})


def replace_table(rows: DataFrame, path: str, chunk_of: Column | None = None) -> None:
    """Write rows in place of what is at path; with chunk_of, one folder for each of its values."""
    if chunk_of is None:
        rows.write.mode("overwrite").parquet(path)
    else:
        rows.withColumn("chunk", chunk_of).write.mode("overwrite").partitionBy("chunk").parquet(path)


def counted(spark: SparkSession, path: str, hits: DataFrame, version: int) -> DataFrame:
    """Monthly counters at path after hits (month, n): the counters of the version before plus these, written as this version."""
    new = hits.groupBy("month").agg(F.sum("n").alias("n"))
    if version:
        new = spark.read.parquet(f"{path}/{version - 1}").unionByName(new).groupBy("month").agg(F.sum("n").alias("n"))
    new.write.mode("overwrite").parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")


def newest(spark: SparkSession, path: str, versions: list[int]) -> DataFrame:
    """The newest complete version of a table; a version without its end mark was cut off while it was written."""
    jvm = spark.sparkContext._jvm
    for v in sorted(versions, reverse=True):
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS")
        if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return spark.read.parquet(f"{path}/{v}")
    raise FileNotFoundError(path)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version among the numbered folders at path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    names = [x.getPath().getName() for x in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return newest(spark, path, [int(x) for x in names if x.isdigit()])
