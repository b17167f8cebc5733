"""Feeds that are polled: each poll is a file, a failed one leaves what the last good one brought."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources.feeds import latest_version


def last_good_poll(spark: SparkSession, polls: str, where: str, schema: str, needed: str) -> DataFrame:
    """The records of the newest poll (a file of one JSON record a line) that holds any with the needed field.

    Polls are taken one by one, the oldest first; each good one becomes a version under where.
    """
    feed = spark.readStream.option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*").text(polls)

    def keep(batch: DataFrame, number: int) -> None:
        got = batch.select(F.from_json("value", schema).alias("r")).filter(F.col(f"r.{needed}").isNotNull()).select("r.*")
        if not got.isEmpty():
            got.write.mode("overwrite").parquet(f"{where}/state/{number}")

    q = feed.writeStream.foreachBatch(keep).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest_version(spark, f"{where}/state")
