"""The nearest reading told by the hour against a plain search."""

import datetime
import random

from wayfare.workloads import live


def test_nearest_hour(spark, tmp_path):
    """Days without a reading, readings in the purchase's own hour, purchases before the first and after the last."""
    r = random.Random(3)
    zero = datetime.datetime(2024, 1, 3)
    rows = [(i, zero + datetime.timedelta(seconds=r.randrange(12 * 86400)), r.choice(["view", "purchase", "error"]), f'{{"k": {r.randrange(100)}}}') for i in range(300)]
    rows = [x for x in rows if x[2] != "view" or x[1].day % 4 == 1]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    at = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds() // 1)
    slots = {}
    for _, t, kind, props in rows:
        if kind == "view" and at(t) // 3600 % 7 == 0:
            slots[at(t) // 3600 * 3600] = max(slots.get(at(t) // 3600 * 3600, 0), int(props[6:-1]))
    want = {(i, s, slots[s]) for i, t, kind, _ in rows if kind == "purchase" for s in [min(slots, key=lambda s: (abs(at(t) - s), s))]}
    out = live.nearest_hour(spark, str(tmp_path))
    got = [tuple(x) for x in out.collect()]
    assert slots and len(got) == len(want) and set(got) == want
    # purchases themselves are not sorted by day
    assert "Window" in out._jdf.queryExecution().optimizedPlan().toString() and "event_id" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x)
