"""Squares and what is met in them go through a shuffle, whatever Spark's estimate of them."""

from pyspark.sql import functions as F

from wayfare.operators import nearest


def test_nothing_broadcast(spark, monkeypatch):
    plans, own = [], nearest.settle

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(nearest, "settle", settle)
    monkeypatch.setattr(nearest, "FEW", 0)
    to = spark.range(200).select("id", (F.col("id") * 37 % 101).alias("qx"), (F.col("id") * 53 % 89).alias("qy")).toDF("node", "qx", "qy")
    points = spark.range(50).select("id", (F.col("id") * 7 - 90).alias("px"), (F.col("id") * 11 % 300 - 80).alias("py"))
    got = {(x.id, x.node, x.d2) for x in nearest.nearest_at_any_distance(points, to, "node", cap=4).collect()}
    at = [(i, i * 37 % 101, i * 53 % 89) for i in range(200)]
    want = {(i, n, d) for i in range(50) for d, n in [min(((i * 7 - 90 - x) ** 2 + (i * 11 % 300 - 80 - y) ** 2, n) for n, x, y in at)]}
    assert got == want and len(plans) > 4
    assert not [p for p in plans if "BroadcastHashJoin" in p]
