"""Queries over feeds in event time: windows that are closed, late and repeated records, an overlay kept up by polls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import feeds
from wayfare.session import settle, shared_folder
from wayfare.streaming.feeds import Overlay, closed_windows, in_event_time
from wayfare.workloads import live

DAY, DELAY_DAYS = 86400, 2
SOURCES = {"a": ("error", "view"), "b": ("click",)}


def _polls(spark: SparkSession, sf: str, where: str) -> dict[str, str]:
    """Four polls of each source: eight days each. A fifth of the records come again with the next poll; of the first eight days, some come with the last poll only."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    second = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = e.withColumns({"second": second, "k": F.from_json("props", "k int")["k"]})
    e = settle(e.crossJoin(F.broadcast(e.agg((F.min(second) / DAY).cast("long").alias("first")))).withColumn("quarter", F.least(F.lit(3), F.expr(f"(second div {DAY} - first) div 8")).cast("int")))  # one row
    late = (F.col("quarter") == 0) & (F.col("event_id") % 17 == 0)
    polls = F.when(late, F.array(F.lit(3))).when((F.col("event_id") % 5 == 0) & (F.col("quarter") < 3), F.array(F.col("quarter"), F.col("quarter") + 1)).otherwise(F.array("quarter"))
    rows = e.select("event_id", "event_type", F.timestamp_seconds("second").alias("at"), "k", F.explode(polls).alias("poll"))
    for poll in range(4):
        for name, kinds in SOURCES.items():
            rows.filter(F.col("poll") == poll).filter(F.col("event_type").isin(*kinds)).select("event_id", "at", "k").coalesce(1).write.parquet(f"{where}/{name}/{poll}")
    return {name: f"{where}/{name}" for name in SOURCES}


def closed_days(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources over four triggers: records and largest value of each day that is over, and how many records came too late."""
    where = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    rows = in_event_time(spark, _polls(spark, sf, f"{where}/polls"), "event_id long, at timestamp, k int", "at", "event_id", f"{DELAY_DAYS} days")
    out, late = closed_windows(rows, "at", "1 day", where, {"records": F.count("*"), "largest": F.max("k")})
    return out.select("source", F.expr(f"start div {DAY}").alias("day"), "records", "largest", F.lit(late).cast("long").alias("late"))


def _merge(parts: dict[str, DataFrame]) -> DataFrame:
    return feeds.merge_sources(parts["a"], parts["b"], ["street"])


def followed_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """The merged records after six polls, each a whole snapshot of one source; a poll rewrites the buckets that it changes."""
    where = f"{shared_folder(spark)}/overlay-{uuid.uuid4().hex}"
    no, shape = F.lit(False), "street long, closed boolean, diversion boolean, surface boolean, weather boolean, severity int, category string, description string"
    a, b = settle(live.feed_a(spark, sf)), settle(live.feed_b(spark, sf))
    for i in range(3):
        for name, rows in (("a", a), ("b", b)):
            seen = feeds.most_severe(rows.filter(F.col("event_id") % 3 <= i), ["street"], "severity", "event_id")
            if name == "a":
                seen = seen.withColumns({"surface": no, "weather": no, "description": F.col("kind")})
            else:
                seen = seen.withColumns({"closed": F.col("kind") == "closure", "diversion": no, "surface": F.col("kind") == "roadworks", "weather": F.col("kind") == "environmental", "category": F.col("kind"), "description": F.col("kind")})
            seen.select(F.lit(name).alias("source"), *[F.col(x.split()[0]).cast(x.split()[1]) for x in shape.split(", ")]).coalesce(1).write.parquet(f"{where}/polls/{2 * i + (name == 'b')}")
    overlay = Overlay(spark, where, "street", _merge, {"a": shape, "b": shape})
    overlay.follow(f"{where}/polls", "source string, " + shape)
    return overlay.read()


QUERIES = {"l01_closed_days": closed_days, "l05_followed_overlay": followed_overlay}

_KINDS = " ".join(f"WHEN event_type IN ({', '.join(repr(k) for k in kinds)}) THEN '{name}'" for name, kinds in SOURCES.items())
ORACLE_SQL = {
    "l01_closed_days": f"""WITH e AS (SELECT event_id, CASE {_KINDS} END AS source, cast(floor(epoch(ts)) AS BIGINT) AS s, cast(json_extract(props, '$.k') AS INTEGER) AS k, (SELECT cast(floor(epoch(min(ts))) AS BIGINT) // {DAY} FROM events) AS first FROM events),
q AS (SELECT *, s // {DAY} AS day, least(3, (s // {DAY} - first) // 8) AS quarter FROM e WHERE source IS NOT NULL),
marked AS (SELECT *, quarter = 0 AND event_id % 17 = 0 AS is_late FROM q),
over AS (SELECT min(last) - {DELAY_DAYS * DAY} AS mark FROM (SELECT source, max(s) AS last FROM q GROUP BY source))
SELECT source, day, count(*) AS records, max(k) AS largest, (SELECT count(*) FROM marked WHERE is_late) AS late FROM marked, over WHERE NOT is_late AND (day + 1) * {DAY} <= mark GROUP BY source, day""",
    "l05_followed_overlay": live.ORACLE_SQL["l04_merged_feeds"],
}
