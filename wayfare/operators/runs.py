"""Ordered operators over paths: runs, cumulative profiles, sampling, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(rows: DataFrame, key: str, seq: str, run_key: str, sums: list[str], firsts: list[str] = ()) -> DataFrame:
    """Adjacent rows (seq one apart) of a key with the same run_key as one row, numbered from 0."""
    w = Window.partitionBy(key).orderBy(seq)
    new = (F.lag(seq).over(w).isNull()) | (F.col(seq) != F.lag(seq).over(w) + 1) | ~F.col(run_key).eqNullSafe(F.lag(run_key).over(w))
    marked = rows.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    pick = [F.min_by(c, F.struct(F.when(F.coalesce(c, F.lit("")) == "", 1).otherwise(0), seq)).alias(c) for c in firsts]
    return marked.groupBy(key, "run").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.first(run_key).alias(run_key), *[F.sum(c).alias(c) for c in sums], *pick)


def running(rows: DataFrame, key: str, seq: str, value: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def sample_evenly(rows: DataFrame, key: str, seq: str, most: int) -> DataFrame:
    """At most `most` rows of each key by rounding i * step half to even; first and last stay. Shorter keys keep all."""
    n = rows.groupBy(key).agg(F.max(seq).alias("_last"))
    picks = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.col("_last"), F.lit(most - 1)).cast("int"))))
    at = F.when(F.col("_last") < most, F.col("_i")).otherwise(F.bround(F.col("_i") * (F.col("_last") / (most - 1))))
    picks = picks.select(key, at.cast("long").alias(seq), F.col("_i").alias("sample"))
    return rows.join(picks, [key, seq])


def without_joints(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("_p", F.lag(value).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")


def until_enough(rows: DataFrame, key: str, order: list[Column], suitable: Column, target: int) -> DataFrame:
    """The prefix of each key up to the row that makes `target` suitable ones."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", suitable.cast("int")).withColumn("_c", F.sum("_s").over(w) - F.col("_s")).filter(F.col("_c") < target).drop("_s", "_c")
