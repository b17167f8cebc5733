"""Dear steps of a zone's axis are worked out once and by several tasks."""

from pyspark.sql import functions as F

from wayfare.operators.polygons import long_axis
from wayfare.workloads import shapes


def test_hull_once(spark):
    pts = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 5), (0, 5)]
    df = spark.createDataFrame([(pts,), ([(3, 3)],), ([],)], "pts array<struct<x: bigint, y: bigint>>")
    out = df.select(long_axis(F.col("pts")).alias("a"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1
    got = [x.a and (x.a.dx, x.a.dy) for x in out.collect()]
    assert got == [(-2.0, 0.0), None, None]  # along the bottom; of equal areas the least dx


def test_ring_edges_tasks(spark, tmp_path):
    spark.range(90).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(50).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(100).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    plan = shapes.ring_edges(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
