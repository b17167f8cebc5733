"""Sharding by balanced label propagation over equal texts.

Linked documents are those of equal text. A link joins a document to its text,
not to every other copy. Labels are shards. In each round a joined text looks up
the shard that holds most of its copies and asks to move the others there; the
moves between two shards are granted up to quotas which keep every shard within
its capacity, so a text with more copies than a shard holds spreads over several.
Copies of a text in one shard are interchangeable, so a round works on counts of
copies by (text, shard). Where shards still hold more than their room after the
rounds, the copies above it move to shards with room: copies of a shard are in
order by prefix sums over buckets of texts, so each is told from its rank where
it goes. At the end documents without links fill the shards up.

Law "rows": the numbers of rows in two shards differ by one at most.

Defined results: a null text has no bytes and no links; an empty text links with
empty texts; repeated rows are placed each; a null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import settle


def _cuts(sizes: list[int], value: Column) -> Column:
    """Index of the interval of the given sizes that value falls in."""
    edge, expr = 0, None
    for i, n in enumerate(sizes):
        edge += n
        expr = F.when(value < edge, i) if expr is None else expr.when(value < edge, i)
    return expr.cast("int")


def _quotas(asked: dict[tuple[int, int], int], load: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from one shard to another: swaps, then what the room allows."""
    granted = {k: min(n, asked.get((k[1], k[0]), 0)) for k, n in asked.items()}
    load = list(load)
    for (a, b), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
        more = max(0, min(n - granted[a, b], room[b] - load[b]))
        granted[a, b] += more
        load[b] += more
        load[a] -= more
    return granted


def _refit(state: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """state (_g, s, n) with the copies above a shard's room moved to shards with room, in order; the state itself if there are none."""
    shards = len(room)
    load = [0] * shards
    for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row for each shard
        load[r["s"]] = r["n"]
    if all(n <= r for n, r in zip(load, room)):
        return state
    # intervals (from, to) of the ranks of shard s that go to shard t
    free, t, steps = [max(0, r - n) for n, r in zip(load, room)], 0, []
    for s in range(shards):
        at = min(load[s], room[s])
        steps.append((s, 0, at, s))
        while at < load[s]:
            while not free[t]:
                t += 1
            n = min(free[t], load[s] - at)
            steps.append((s, at, at + n, t))
            at, free[t] = at + n, free[t] - n
    plan = state.sparkSession.createDataFrame(steps, "s int, lo long, hi long, to int")
    # texts of many copies are last within their buckets, so that they leave and texts of few stay whole
    rows = state.withColumn("_k", F.pmod(F.xxhash64("_g"), F.lit(buckets)))
    sums = rows.groupBy("s", "_k").agg(F.sum("n").alias("m"), F.max("n").alias("most"))
    sums = sums.withColumn("base", F.sum("m").over(Window.partitionBy("s").orderBy("most", "_k")) - F.col("m"))  # a row for each shard and bucket
    rows = rows.join(sums.select("s", "_k", "base"), ["s", "_k"])
    end = F.col("base") + F.sum("n").over(Window.partitionBy("s", "_k").orderBy("n", "_g"))
    rows = rows.withColumn("end", end).join(F.broadcast(plan), "s")  # at most twice the shards
    part = F.least("end", "hi") - F.greatest(F.col("end") - F.col("n"), "lo")
    return settle(rows.withColumn("part", part).filter("part > 0").groupBy("_g", F.col("to").alias("s")).agg(F.sum("part").alias("n")))


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text", groups_in_bucket: int = 20_000) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot, grown_shard, n_equal (documents of this text)."""
    text = F.col(text_col).cast("string")
    total = docs.count()
    parts_of_text = shards * max(8, -(-total // groups_in_bucket // shards))
    d = settle(
        docs.select(
            F.col(id_col),
            (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("_g"),
        ).withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(parts_of_text)).cast("int"))
    )
    room = [total // shards + (i < total % shards) for i in range(shards)]
    parts = d.filter("_g IS NOT NULL").groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    by_text = Window.partitionBy("_g")
    parts = settle(parts.withColumn("n_equal", F.sum("_n").over(by_text)).withColumn("_before", F.sum("_n").over(by_text.orderBy("_b")) - F.col("_n")).filter("n_equal > 1"))
    state = settle(parts.groupBy("_g", F.pmod("_b", F.lit(shards)).alias("s")).agg(F.sum("_n").alias("n")))
    buckets = max(1, state.count() // groups_in_bucket)
    for turn in range(rounds):
        load = [0] * shards
        for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            load[r["s"]] = r["n"]
        # every other round prefers shards with room, for texts whose favourite is full
        open_to = F.col("s").isin([s for s in range(shards) if load[s] < room[s]]) if turn % 2 else F.lit(True)
        best = F.first("s").over(by_text.orderBy(F.desc(open_to), F.desc("n"), F.pmod(F.xxhash64("_g") + F.col("s"), F.lit(shards)), "s"))
        moves = state.withColumn("to", best)
        asked = {(r["s"], r["to"]): r["n"] for r in moves.filter("s <> to").groupBy("s", "to").agg(F.sum("n").alias("n")).collect()}  # at most shards squared
        granted = _quotas(asked, load, room)
        if not any(granted.values()):
            if asked and turn + 1 < rounds:
                continue
            break
        if granted == asked:
            state = settle(moves.groupBy("_g", F.col("to").alias("s")).agg(F.sum("n").alias("n")))
            continue
        # share each quota among buckets of texts by what they ask for; texts with few copies to move go first
        quota = d.sparkSession.createDataFrame([(a, b, granted[a, b], n) for (a, b), n in asked.items()], "s int, to int, quota long, asked long")
        moves = moves.withColumn("_k", F.pmod(F.xxhash64("_g"), F.lit(buckets)))
        own = Window.partitionBy("s", "to", "_k")
        moves = (
            moves.join(F.broadcast(quota), ["s", "to"], "left")  # at most shards squared
            .withColumn("share", F.floor(F.col("quota") * F.sum("n").over(own) / F.col("asked")))
            .withColumn("cum", F.sum("n").over(own.orderBy("n", "_g")) - F.col("n"))
            .withColumn("go", F.when(F.col("s") == F.col("to"), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.col("share") - F.col("cum")))).cast("long"))
        )
        split = moves.select("_g", F.explode(F.array(F.struct(F.col("s").alias("s"), (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("s"), F.col("go").alias("n")))).alias("x"))
        state = settle(split.select("_g", "x.*").filter("n > 0").groupBy("_g", "s").agg(F.sum("n").alias("n")))
    state = _refit(state, room, buckets)
    load = [0] * shards
    for r in state.groupBy("s").agg(F.sum("n").alias("n")).collect():
        load[r["s"]] = r["n"]
    ends = state.withColumn("hi", F.sum("n").over(by_text.orderBy("s"))).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("hi", "s"))).alias("_ends"))  # at most a row for each shard
    linked = parts.join(ends, "_g").select("_g", "_b", "_before", "_ends", "n_equal")
    d = d.join(linked, ["_g", "_b"], "left")
    nth = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(F.col(id_col))) - 1 + F.col("_before")
    d = settle(d.withColumn("_nth", F.when(F.col("_ends").isNotNull(), nth)).withColumn("_shard", F.element_at(F.filter("_ends", lambda e: F.col("_nth") < e["hi"]), 1)["s"]).withColumn("_c", F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(max(64, total // groups_in_bucket)))))
    # documents without links fill up the shards in the order of their buckets
    alone = d.filter("_shard IS NULL")
    before = alone.groupBy("_c").agg(F.count("*").alias("_n")).withColumn("_from", F.sum("_n").over(Window.orderBy("_c")) - F.col("_n")).drop("_n")  # a row for each bucket
    at = F.row_number().over(Window.partitionBy("_c").orderBy(id_col)) - 1 + F.col("_from")
    alone = alone.join(before, "_c").withColumn("_shard", _cuts([r - n for r, n in zip(room, load)], at)).drop("_from")
    placed = alone.unionByName(d.filter("_shard IS NOT NULL")).select(id_col, "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), "_c", F.coalesce("n_equal", F.lit(1)).cast("long").alias("n_equal"))
    sizes = placed.groupBy("shard", "_c").agg(F.count("*").alias("_n"))
    first = sizes.select("shard", "_c", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_c")) - F.col("_n")).alias("_from"))
    slot = F.row_number().over(Window.partitionBy("shard", "_c").orderBy(id_col)) - 1 + F.col("_from")
    return placed.join(first, ["shard", "_c"]).select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_equal")
