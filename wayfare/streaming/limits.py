"""Rate limits as stateful streams: what a key has left depends on what it was granted before.

State is one short array of times for each key, at most as long as the limit.
It has an event-time timer: once the watermark has passed everything that the
array can still decide, the key's state is removed. A file of the source is a
slice of time and a trigger of its own, so a task holds times and ids of one
key and one slice at a time, and puts those in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import shared_folder, ship


def stateful(rows: DataFrame, where: str, span_s: int, step: Callable) -> tuple[DataFrame, int]:
    """A stream of rows (key, event_id, event_type, second) through step, one state for each key: (event_id, key, allowed), and the keys whose state is left at the end.

    step takes and gives (times kept, locked until); neither counts any more once the later of the last time plus
    span_s, and of until, is over.
    """
    ship(rows.sparkSession)

    def run(own: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, until = state.get if state.exists else ([], 0)
        got = [(p["second"].to_numpy(), p["event_id"].to_numpy(), p["event_type"].to_numpy()) for p in parts]
        second, event, kind = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((event, second))
        kept, allowed = list(kept), []
        for t, k in zip(second[order].tolist(), kind[order].tolist()):
            kept, until, ok = step(kept, until, t, k)
            allowed.append(ok)
        over = (max([until, *(t + span_s for t in kept)]) + 1) * 1000
        if over > max(state.getCurrentWatermarkMs(), 0):
            state.update((kept, until))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": event[order], "key": own[0], "allowed": allowed})

    timed = rows.withColumn("at", F.timestamp_seconds("second")).withWatermark("at", f"{span_s} seconds")
    out = timed.groupBy("key").applyInPandasWithState(run, "event_id long, key long, allowed boolean", "kept array<long>, until long", "append", "EventTimeTimeout")
    q = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else 0
    return rows.sparkSession.read.schema("event_id long, key long, allowed boolean").parquet(f"{where}/out"), left


def _of_events(spark: SparkSession, sf_dir: str, key: str, types: tuple[str, ...] | None, span_s: int, step: Callable) -> DataFrame:
    """The events table as a stream through step."""
    where = f"{shared_folder(spark)}/limits-{uuid.uuid4().hex}"
    shape = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = rows.filter(F.col("event_type").isin(*types)) if types else rows
    second = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    out, _ = stateful(rows.select(F.col(key).cast("long").alias("key"), "event_id", "event_type", second.alias("second")), where, span_s, step)
    return out.select("event_id", F.col("key").alias(key), "allowed")


def budget(window_s: int, limit: int) -> Callable:
    """Allowed while fewer than limit allowed hits lie in the window before."""

    def step(kept, until, t, kind):
        kept = [x for x in kept if x > t - window_s]
        ok = len(kept) < limit
        return kept + [t] if ok else kept, until, ok

    return step


def budget_stream(spark: SparkSession, sf_dir: str, key: str, window_s: int, limit: int) -> DataFrame:
    """Hits of a key against its budget."""
    return _of_events(spark, sf_dir, key, None, window_s, budget(window_s, limit))


def lockout_stream(spark: SparkSession, sf_dir: str, window_s: int, failures: int, lock_s: int) -> DataFrame:
    """Attempts and failures of a user: the failure that fills the window locks for lock_s and clears the count."""

    def step(kept, until, t, kind):
        ok = until <= t
        if kind == "error":
            kept = [x for x in kept if x > t - window_s] + [t]
            if len(kept) >= failures:
                kept, until = [], t + lock_s
        return kept, until, ok

    return _of_events(spark, sf_dir, "user_id", ("error", "click"), max(window_s, lock_s), step)
