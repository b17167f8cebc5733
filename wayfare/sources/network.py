"""Reading feeds and boundary files, and keeping a built network with its fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
STATIONS = "id string, commonName string, lat double, lon double, additionalProperties array<struct<key:string,value:string>>"


def csv(spark: SparkSession, path: str, columns: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header, as far as the named columns exist (in any case)."""
    df = spark.read.csv(path, header=True)
    there = {c.lower(): c for c in df.columns}
    out = df.select(*[F.col(f"`{there[c.lower()]}`").alias(c) for c in columns if c.lower() in there])
    return out.withColumnsRenamed(renamed or {})


def geojson_segments(spark: SparkSession, path: str, name_key: str) -> DataFrame:
    """name, line, seq, ax, ay, bx, by: segments of the MultiLineString features of a GeoJSON file."""
    rows = spark.read.schema(LINES).option("multiLine", True).json(path)
    f = rows.select(F.explode("features").alias("f")).filter("f.geometry.type = 'MultiLineString'")
    line = f.select(F.col("f.properties")[name_key].alias("name"), F.posexplode("f.geometry.coordinates").alias("line", "pts"))
    ends = line.select("name", "line", F.posexplode(F.expr("transform(slice(pts, 1, size(pts) - 1), (p, i) -> struct(p AS a, pts[i + 1] AS b))")).alias("seq", "s"))
    return ends.select("name", "line", "seq", *[F.col(f"s.{p}")[i].alias(p + "xy"[i]) for p in ("a", "b") for i in (0, 1)])


def stations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Hire stations that are installed and not locked, with their counters."""
    rows = spark.read.schema(STATIONS).option("multiLine", multi_line).json(path)
    kv = F.map_from_entries(F.transform("additionalProperties", lambda p: F.struct(p["key"], p["value"])))
    rows = rows.withColumn("p", kv).filter("lower(p['Installed']) = 'true' AND lower(coalesce(p['Locked'], 'false')) <> 'true'")
    return rows.select("id", F.col("commonName").alias("name"), "lat", "lon", *[F.col("p")[k].try_cast("int").alias(n) for k, n in (("NbBikes", "bikes"), ("NbEmptyDocks", "empty"), ("NbDocks", "docks"))])


def fingerprint(df: DataFrame) -> DataFrame:
    """n and h: row count and an order-free sum of row hashes."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("h"))


def save(nodes: DataFrame, edges: DataFrame, path: str, formula: str) -> None:
    """Write a network, then what it was built from and by which formula."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    fingerprint(edges).withColumn("formula", F.lit(formula)).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, edges: DataFrame, formula: str) -> tuple[DataFrame, DataFrame] | None:
    """The stored network; None where it was built from other edges or by another formula."""
    kept, now = spark.read.parquet(f"{path}/meta").first(), fingerprint(edges).first()
    if (kept["n"], kept["h"], kept["formula"]) != (now["n"], now["h"], formula):
        return None
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
