"""Feeds in event time, and an overlay that follows them by rewriting what has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def in_event_time(spark: SparkSession, polls: dict[str, str], schema: str, at: str, key: str, delay: str) -> DataFrame:
    """Several polled sources (name: folder of Parquet files, a file a poll) as one stream with a watermark.

    A record that a source repeats within the delay counts once; the state that tells so is let go after it.
    """
    out = None
    for name, folder in polls.items():
        one = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).parquet(folder)
        one = one.withColumn("source", F.lit(name)).withWatermark(at, delay)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicatesWithinWatermark(["source", key])


def closed_windows(records: DataFrame, at: str, width: str, where: str, measures: dict[str, Column]) -> tuple[DataFrame, int]:
    """Measures of each source and window that no further record can reach, and how many records came too late for theirs."""
    spark = records.sparkSession
    out = records.groupBy("source", F.window(at, width).alias("w")).agg(*[m.alias(c) for c, m in measures.items()])
    q = out.select("source", F.unix_timestamp("w.start").alias("start"), *measures).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.parquet(f"{where}/out"), late


class Overlay:
    """Records of several sources merged by key, kept in buckets of which a poll rewrites only those with changes.

    Everything that poll n writes lies under its number, and it reads lower numbers only, so a poll that is
    processed again (its first try was lost on the way) leaves what it left before. A version is complete once its
    list of buckets is written, which comes last.
    """

    def __init__(self, spark: SparkSession, where: str, key: str, merge: Callable[[dict[str, DataFrame]], DataFrame], schemas: dict[str, str], buckets: int = 16):
        self.spark, self.where, self.key, self.merge, self.schemas, self.buckets = spark, where, key, merge, schemas, buckets

    def _versions(self, before: int | None = None) -> dict[str, dict[int, int]]:
        """For the newest complete version: the poll of each source's snapshot, and the poll that wrote each bucket."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.where}/lists")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return {}
        lists = self.spark.read.schema("number long, kind string, name string, version long").json(f"{self.where}/lists/*")
        lists = lists if before is None else lists.filter(F.col("number") < before)
        last = lists.agg(F.max("number")).first()[0]
        if last is None:
            return {}
        out: dict[str, dict] = {"snapshot": {}, "bucket": {}}
        for r in lists.filter(F.col("number") == last).collect():  # a row for each source and bucket
            out[r["kind"]][r["name"]] = r["version"]
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _snapshot(self, source: str, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.schemas[source])
        return self.spark.read.schema(self.schemas[source]).parquet(f"{self.where}/snapshots/{source}/{version}")

    def apply(self, source: str, snapshot: DataFrame, number: int) -> list[int]:
        """Take a whole snapshot of a source as poll `number`; the buckets rewritten. An empty one is a failed poll and changes nothing."""
        if snapshot.isEmpty():
            return []
        have = self._versions(number)
        snapshots, buckets = dict(have.get("snapshot", {})), dict(have.get("bucket", {}))
        old = self._snapshot(source, snapshots.get(source))
        snapshot.select(*old.columns).write.mode("overwrite").parquet(f"{self.where}/snapshots/{source}/{number}")
        snapshots[source] = number
        new = self._snapshot(source, number)
        # rows of either snapshot without their like in the other
        mark = lambda d, n: d.select(self.key, F.xxhash64(*d.columns).alias(n))
        changed = mark(old, "x").join(mark(new, "y"), self.key, "full").filter(~F.col("x").eqNullSafe(F.col("y")))
        touched = sorted(r["b"] for r in changed.select(self._bucket().alias("b")).distinct().collect())  # as many as buckets
        if touched:
            parts = {s: self._snapshot(s, snapshots.get(s)).filter(self._bucket().isin(touched)) for s in self.schemas}
            merged = self.merge(parts).withColumn("bucket", self._bucket())
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.where}/overlay/{number}")
            buckets |= {str(b): number for b in touched}
        rows = [(number, "snapshot", s, v) for s, v in snapshots.items()] + [(number, "bucket", b, v) for b, v in buckets.items()]
        self.spark.createDataFrame(rows, "number long, kind string, name string, version long").coalesce(1).write.mode("overwrite").json(f"{self.where}/lists/{number}")
        return touched

    def read(self) -> DataFrame:
        """The newest complete version."""
        buckets = self._versions().get("bucket", {})
        out = None
        for version in sorted(set(buckets.values())):
            own = [int(b) for b, v in buckets.items() if v == version]
            part = self.spark.read.parquet(f"{self.where}/overlay/{version}").filter(F.col("bucket").isin(own)).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.merge({s: self._snapshot(s, None) for s in self.schemas})

    def follow(self, polls: str, schema: str) -> None:
        """Take the polls in a folder that haven't been taken yet, a file a poll; a file holds one source's records."""
        feed = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).parquet(polls)

        def take(batch: DataFrame, number: int) -> None:
            for r in batch.select("source").distinct().collect():  # one
                self.apply(r["source"], batch.filter(F.col("source") == r["source"]), number)

        feed.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.where}/log").trigger(availableNow=True).start().awaitTermination()
