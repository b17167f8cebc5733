"""Links and barred nodes don't pass through the driver in each hop."""

from wayfare.operators import expansion


def test_nothing_broadcast(spark, monkeypatch):
    plans, own = [], expansion.settle

    def settle(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(expansion, "settle", settle)
    links = spark.createDataFrame([(i, i + 1, 1) for i in range(9)], "u long, v long, cost long")
    sources, barred = spark.createDataFrame([(0, 0), (5, 5)], "source long, node long"), spark.createDataFrame([(5, 7)], "source long, node long")
    got = {tuple(x) for x in expansion.expand(links, sources, 4, barred=barred).collect()}
    assert got == {(0, i, i) for i in range(5)} | {(5, 5, 0), (5, 6, 1)}
    assert len(plans) > 2 and not [p for p in plans if "BroadcastHashJoin" in p]
