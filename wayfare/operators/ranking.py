"""Numbers over a whole table or within large keys, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import settle


def global_rank(rows: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """rows with out, gapless from 1 in the given order: ranges are counted, and each row adds its range's start."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row for each of n ranges
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(F.broadcast(before), "_p").withColumn(out, (F.col("_before") + at).cast("bigint")).drop("_p", "_before")


def rank_within(rows: DataFrame, key: str, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """rows with out, gapless from 1 in the given order within each key, however many rows the key has; null is a key.

    Rows are dealt by ranges of (key, order), so a large key spans ranges. Of a range only the first key can have begun
    in an earlier one: what comes before is one number for each range.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(n, key, *order).withColumn("_p", F.spark_partition_id()))
    held = dealt.groupBy("_p").agg(F.min(F.struct(key)).alias("_first"), F.max(F.struct(key)).alias("_last"))
    sizes = dealt.groupBy("_p", F.struct(key).alias("_k")).agg(F.count("*").alias("_n"))
    # of each range the rows of its last key, which later ranges may go on with: one row for each of n ranges
    ends = held.join(sizes, (held["_p"] == sizes["_p"]) & held["_last"].eqNullSafe(sizes["_k"])).select(held["_p"], "_first", "_last", "_n")
    so_far = F.sum("_n").over(Window.partitionBy("_last").orderBy("_p"))
    ends = ends.select("_p", "_last", so_far.alias("_sum"))
    a, b = held.select("_p", "_first").alias("a"), ends.alias("b")
    before = a.join(b, (F.col("b._p") < F.col("a._p")) & F.col("b._last").eqNullSafe(F.col("a._first")), "left").groupBy("a._p", "a._first").agg(F.coalesce(F.max("b._sum"), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_p", key).orderBy(*order))
    joined = dealt.join(F.broadcast(before), "_p")
    start = F.when(F.struct(key).eqNullSafe(F.col("_first")), F.col("_before")).otherwise(0)
    return joined.withColumn(out, (start + at).cast("bigint")).drop("_p", "_first", "_before")
