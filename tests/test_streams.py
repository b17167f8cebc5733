"""Streams: state that expires, records that come late, polls that are processed again."""

import pytest
from pyspark.sql import functions as F

from wayfare.streaming.feeds import Overlay, closed_windows, in_event_time
from wayfare.streaming.limits import budget, stateful


def test_state_is_gone_after_the_window(spark, tmp_path):
    """Three slices of time; keys that were last seen in the first have no state left, and what they were granted stays right."""
    shape, want, kept = "key long, event_id long, event_type string, second long", {}, {}
    rows = [[(k, 100 * s + 10 * i + k, "x", s * 10_000 + i * 30 + k) for k in range(5) for i in range(6)] for s in (1, 2, 3)]
    rows[1] = [x for x in rows[1] if x[0] < 3]
    rows[2] = [x for x in rows[2] if x[0] == 0]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        for k, e, _, t in sorted(part, key=lambda x: (x[3], x[1])):
            own = [x for x in kept.get(k, []) if x > t - 100]
            want[e, k] = len(own) < 3
            kept[k] = own + [t] if len(own) < 3 else own
    feed = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out, left = stateful(feed, str(tmp_path), 100, budget(100, 3))
    assert {(x.event_id, x.key): x.allowed for x in out.collect()} == want and not all(want.values())
    assert left <= 1


def test_late_and_repeated_records(spark, tmp_path):
    shape = "event_id long, at timestamp, k int"
    polls = [[(1, 100, 1), (2, 200, 5)], [(2, 200, 5), (3, 5000, 2)], [(4, 9000, 3)], [(5, 150, 9), (6, 12_000, 1)], [(7, 20_000, 1)]]
    for n, part in enumerate(polls):
        spark.createDataFrame(part, "event_id long, s long, k int").select("event_id", F.timestamp_seconds("s").alias("at"), "k").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    rows = in_event_time(spark, {"a": f"{tmp_path}/in"}, shape, "at", "event_id", "1000 seconds")
    out, late = closed_windows(rows, "at", "1000 seconds", str(tmp_path), {"n": F.count("*"), "most": F.max("k")})
    assert sorted(tuple(x) for x in out.collect()) == [("a", 0, 2, 5), ("a", 5000, 1, 2), ("a", 9000, 1, 3), ("a", 12_000, 1, 1)]
    assert late == 1


@pytest.fixture
def overlay(spark, tmp_path):
    merge = lambda p: p["a"].join(p["b"].withColumnRenamed("v", "w"), "street", "full")
    return Overlay(spark, str(tmp_path / "o"), "street", merge, {"a": "street long, v int", "b": "street long, v int"}, buckets=8)


def test_overlay_rewrites_what_changes(spark, overlay):
    table = lambda rows: spark.createDataFrame(rows, "street long, v int")
    shown = lambda: sorted((tuple(x) for x in overlay.read().collect()), key=repr)
    assert shown() == []
    a, b = [(i, i) for i in range(40)], [(i, -i) for i in range(30, 50)]
    assert overlay.apply("a", table(a), 0) == list(range(8))
    overlay.apply("b", table(b), 1)
    both = lambda a, b: sorted(((s, dict(a).get(s), dict(b).get(s)) for s in {*dict(a), *dict(b)}), key=repr)
    assert shown() == both(a, b)
    changed = [(s, 99 if s == 7 else v) for s, v in a if s != 11]
    touched = overlay.apply("a", table(changed), 2)
    assert 1 <= len(touched) <= 2 and shown() == both(changed, b)
    # the same poll again, a failed poll, and one without changes
    before = shown()
    assert overlay.apply("a", table(changed), 2) == touched and shown() == before
    assert overlay.apply("b", table([]), 3) == [] and overlay.apply("b", table(b), 4) == [] and shown() == before
    # a poll that is lost half way leaves no list of buckets, so readers stay with the version before
    overlay.apply("a", table(a), 5)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{overlay.where}/lists/5")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    assert shown() == before
    overlay.apply("a", table(a), 5)
    assert shown() == both(a, b)
