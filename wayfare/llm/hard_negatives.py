"""Hard-negative mining: for each anchor and positive, the best rows of other labels whose score lies in a window below the positive's.

Vectors become whole numbers, floor(scale * x), packed into blocks of rows. A
score is the integer inner product of an anchor and a candidate. Scores come from
tiles (anchors by candidates) that are multiplied by Strassen's recursion: odd
sides are padded with zeros, sums of quarters are exact 64-bit additions, and
small tiles are multiplied in float64 where a bound proves that every sum stays
below 2^53, in int64 below 2^63, and in Python's integers beyond.

Anchors are a stated query set. They are taken in chunks of at most chunk_bytes,
and only such a chunk is broadcast; the candidates are read in place, so no
vector is shuffled. A task keeps heaps for the anchors of the chunk as it runs
over its blocks and returns them when it ends; heaps of several tasks merge by
rank. The first pass keeps each anchor's positives (candidates of its label), the
second a heap for each anchor and positive with the scores inside the window.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; an empty vector has score 0 with all others, and a
shorter one counts as padded with zeros; repeated rows are rows of their own, and
only the anchor itself is no positive of its own; a null id is no anchor and
counts as larger than all others among ties; scores beyond 64 bits count as the largest or smallest 64-bit number, and a component that isn't finite once
scaled counts as not finite. An empty table, an
anchor without positives, and a positive without a row in its window give no
rows. Columns other than the three named aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.blocks import BLOCK_BITS, NULL_ID, ids_of, tidied
from wayfare.llm.repeats import rows_of
from wayfare.session import settle, ship

#: Rows of a block; a row's key is its block's number times this, plus its place.
ROWS = 4096
#: Anchors of a tile; its candidates are a block's.
TILE = 512
PACKED = "keys binary, ids binary, labels binary, width int, kind string, data binary"
LOWEST = np.iinfo(np.int64).min


def _reach(a: np.ndarray) -> int:
    return max(int(a.max()), -int(a.min())) if a.size else 0


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object:
        return a @ b
    if _reach(a) * _reach(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2))) if x.shape[0] % 2 or x.shape[1] % 2 else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """The exact product of two matrices of integers by seven products of quarters, down to sides of leaf."""
    m, n = a.shape[0], b.shape[1]
    if min(m, n, a.shape[1]) <= leaf:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


def _whole(x: np.ndarray) -> np.ndarray:
    """Python's integers."""
    return np.frompyfunc(int, 1, 1)(x).astype(object) if x.size else x.astype(object)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and the rows of b; the narrower rows are padded with zeros."""
    width = max(a.shape[1], b.shape[1], 1)
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if _reach(a) * _reach(b) * width < 2**63:
        # within the recursion sums may wrap around 64 bits, which the last additions undo
        return strassen(a.astype(np.int64), np.ascontiguousarray(b.T).astype(np.int64))
    exact = strassen(_whole(a), _whole(b.T))
    return np.clip(exact, LOWEST, NULL_ID).astype(np.int64)


class Heaps:
    """For each of n owners, the k best (score, id) seen so far; higher scores first, ties by smaller id. Two of them merge."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, k), np.int64)
        self.id = np.zeros((n, k), np.int64)
        self.full = np.zeros((n, k), bool)

    def merge(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
        """Rows of further entries for the owners `who` (each named once)."""
        score, ids, full = (np.concatenate([x[who], y], axis=1) for x, y in ((self.score, score), (self.id, ids), (self.full, full)))
        order = np.lexsort((ids, ~score, ~full), axis=1)[:, : self.k]  # ~x falls as x grows, and can't overflow
        self.score[who], self.id[who], self.full[who] = (np.take_along_axis(x, order, axis=1) for x in (score, ids, full))

    def push(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, able: np.ndarray) -> None:
        """A tile: scores of the owners `who` (rows) with candidates in ascending order of ids (columns), where able."""
        able = able & (~self.full[who, -1:] | (score >= self.score[who, -1:]))
        some = able.any(axis=1)
        who, score, able = who[some], score[some], able[some]
        if not len(who):
            return
        at = np.arange(len(who))
        left = np.where(able, score, LOWEST)
        new = [np.zeros((len(who), self.k), t) for t in (np.int64, np.int64, bool)]
        for r in range(self.k):
            j = left.argmax(axis=1)  # the first of equals, which has the least id
            lost = ~able[at, j]
            j[lost] = able[lost].argmax(axis=1)  # nothing is left, or only scores of LOWEST are
            new[0][:, r], new[1][:, r], new[2][:, r] = score[at, j], ids[j], able[at, j]
            left[at, j] = LOWEST
            able[at, j] = False
        self.merge(who, *new)


def whole_numbers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, floor(scale * x) of their components as a matrix padded with zeros) of a column of lists of doubles."""
    there = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = column.flatten()  # leaves out what null lists may hold
    raw = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes nan
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(raw * float(scale))
    owner = np.repeat(np.arange(len(size)), size)
    usable = there.copy()
    usable[owner[~np.isfinite(scaled)]] = False
    rows = np.flatnonzero(usable)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    mine = usable[owner]
    out = np.zeros((len(size), int(size[rows].max()) if len(rows) else 0))
    out[owner[mine], place[mine]] = scaled[mine]
    return rows, _narrow(out[rows])


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest type that holds these whole numbers; float64 holds those beyond 64 bits."""
    most = _reach(x)
    return next((x.astype(k) for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max), x.astype(np.float64))


class Packed:
    """A block of rows in ascending order of ids."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.data = np.frombuffer(row["data"], row["kind"]).reshape(len(self.ids), row["width"])


def _row(keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, data: np.ndarray) -> dict:
    data = np.ascontiguousarray(_narrow(data))
    return {"keys": [keys.tobytes()], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "width": pa.array([data.shape[1]], pa.int32()), "kind": [data.dtype.str], "data": [data.tobytes()]}


def _is_anchor(ids: np.ndarray, every: int) -> np.ndarray:
    return (ids % every == 0) & (ids != NULL_ID)


def _packed(rows: DataFrame, scale: int, every: int) -> DataFrame:
    """rows (id, label, vector) as settled blocks; anchors and bytes: its anchors' number and size."""

    def run(batches):
        number = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                own = batch.slice(a, ROWS)
                ids = ids_of(own.column(0))
                usable, data = whole_numbers(own.column(2), scale)
                if not len(usable):
                    continue
                order = np.argsort(ids[usable], kind="stable")
                ids, labels = ids[usable][order], own.column(1).to_numpy(zero_copy_only=False)[usable][order]
                mine = int(_is_anchor(ids, every).sum())
                yield pa.RecordBatch.from_pydict({"block": [number], "anchors": [mine], "bytes": [mine * (24 + 8 * data.shape[1])], **_row(number * ROWS + np.arange(len(ids)), ids, labels, data[order])})
                number += 1

    return settle(rows.mapInArrow(tidied(run), f"block long, anchors long, bytes long, {PACKED}"))


class Anchors:
    """A chunk of anchors, those of one label together."""

    def __init__(self, rows: list):
        found = [Packed(r) for r in rows]
        labels = np.concatenate([x.labels for x in found])
        ids, keys = (np.concatenate([getattr(x, c) for x in found]) for c in ("ids", "keys"))
        order = np.lexsort((keys, labels))
        self.ids, self.keys, self.labels = ids[order], keys[order], labels[order]
        width = max(x.data.shape[1] for x in found)
        self.data = np.concatenate([np.pad(x.data, ((0, 0), (0, width - x.data.shape[1]))) for x in found])[order]

    def tiles(self, lo: int = 0, hi: int | None = None):
        hi = len(self.ids) if hi is None else hi
        return [np.arange(a, min(hi, a + TILE)) for a in range(lo, hi, TILE)]


def _chunks(blocks: DataFrame, every: int, chunk_bytes: int):
    """The anchors, some at a time; chunk_bytes is about what one chunk takes."""
    total = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    count = -(-total // chunk_bytes)

    def run(batches):
        for row in rows_of(batches):
            own = Packed(row)
            at = np.flatnonzero(_is_anchor(own.ids, every))
            yield pa.RecordBatch.from_pydict(_row(own.keys[at], own.ids[at], own.labels[at], own.data[at]))

    names = [x.split()[0] for x in PACKED.split(", ")]
    with_chunk = blocks.filter("anchors > 0").withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(count)))
    for c in range(count):
        rows = with_chunk.filter(F.col("chunk") == c).select(*names).mapInArrow(tidied(run), PACKED).collect()  # chunk_bytes bounds it
        if rows:
            yield Anchors(rows)


def _ranked(found: DataFrame, owner: list[str], k: int) -> DataFrame:
    """The k best of each owner, with their rank: the tasks' heaps merged."""
    best = F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def _positives(blocks: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(key, id, score, rank): each anchor's first k other rows of its label."""
    sent = blocks.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        own = sent.value
        heaps = Heaps(len(own.ids), k)
        for row in rows_of(batches):
            block = Packed(row)
            for label in np.unique(block.labels):
                lo, hi = np.searchsorted(own.labels, [label, label], "left")[0], np.searchsorted(own.labels, label, "right")
                at = np.flatnonzero(block.labels == label)
                for who in own.tiles(int(lo), int(hi)):
                    heaps.push(who, scores(own.data[who], block.data[at]), block.ids[at], own.keys[who][:, None] != block.keys[at])
        yield _entries(heaps, {"key": own.keys})

    return _ranked(blocks.mapInArrow(tidied(run), "key long, id long, score long"), ["key"], k)


def _negatives(blocks: DataFrame, anchors: Anchors, positives: dict[int, list[int]], k: int, low: int, high: int) -> DataFrame:
    """(key, positive_score, id, score, rank): for each anchor and score of a positive, the first k rows of other labels in its window."""
    slots: list[tuple[list[int], list[int]]] = []  # places of anchors and their r-th distinct score
    for i, key in enumerate(anchors.keys.tolist()):
        for r, p in enumerate(sorted(set(positives.get(key, ())), reverse=True)):
            if r == len(slots):
                slots.append(([], []))
            slots[r][0].append(i)
            slots[r][1].append(p)
    windows = []
    base = 0
    for who, p in slots:
        # 64-bit bounds on the score, worked out in Python's integers
        windows.append((np.array(who), np.array(p), np.array([-((-low * x) // 100) for x in p]), np.array([high * x // 100 for x in p]), base))
        base += len(who)
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches):
        own, windows = sent.value
        heaps = Heaps(sum(len(w[0]) for w in windows), k)
        for row in rows_of(batches):
            block = Packed(row)
            for who in own.tiles():
                score = scores(own.data[who], block.data)
                other = own.labels[who][:, None] != block.labels
                for place, _, lo, hi, first in windows:
                    a, b = np.searchsorted(place, [who[0], who[-1] + 1])
                    at = place[a:b] - who[0]
                    heaps.push(first + np.arange(a, b), score[at], block.ids, other[at] & (score[at] >= lo[a:b, None]) & (score[at] <= hi[a:b, None]))
        key = np.concatenate([np.empty(0, np.int64), *(own.keys[w[0]] for w in windows)])
        p = np.concatenate([np.empty(0, np.int64), *(w[1] for w in windows)])
        yield _entries(heaps, {"key": key, "positive_score": p})

    return _ranked(blocks.mapInArrow(tidied(run), "key long, positive_score long, id long, score long"), ["key", "positive_score"], k)


def _entries(heaps: Heaps, owner: dict[str, np.ndarray]) -> pa.RecordBatch:
    who, at = np.nonzero(heaps.full)
    return pa.RecordBatch.from_pydict({**{c: v[who] for c, v in owner.items()}, "id": heaps.id[who, at], "score": heaps.score[who, at]})


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, chunk_bytes: int = 16 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by every. A negative's score times
    100 lies between low and high times the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter("label IS NOT NULL AND vector IS NOT NULL")
    blocks = _packed(rows, scale, every)
    out = None
    for anchors in _chunks(blocks, every, chunk_bytes):
        near = settle(_positives(blocks, anchors, positives))
        of: dict[int, list[int]] = {}
        for r in near.select("key", "score").collect():  # `positives` numbers for each anchor of the chunk
            of.setdefault(r["key"], []).append(r["score"])
        far = _negatives(blocks, anchors, of, negatives, low, high)
        ids = spark.createDataFrame(pa.table({"key": anchors.keys, "anchor_id": anchors.ids}))
        found = near.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank"))
        found = found.join(far.select("key", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "positive_score"]).join(ids, "key")
        found = settle(found.select("anchor_id", F.nullif("positive_id", F.lit(int(NULL_ID))).alias("positive_id"), "rank", F.nullif("negative_id", F.lit(int(NULL_ID))).alias("negative_id"), "positive_score", "negative_score", "positive_rank"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    return out


#: The query's rows for DuckDB; rows are told apart by number, as ids may repeat.
ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_dot_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k
  FROM s WHERE alike QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, k,
         row_number() OVER (PARTITION BY p.r, k ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(k AS INTEGER) AS positive_rank FROM n WHERE rank <= 3
"""
