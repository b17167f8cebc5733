"""Suffix-array dedup over bytes by the difference-cover algorithm.

Passages that several texts share are dealt by content to shards. A shard sorts
the suffixes of its passages with the difference cover {1, 2} mod 3: sampled
triples are sorted and named, the string of names is sorted by recursion until
names are distinct, and the remaining suffixes are merged in by the ranks of the sample. Adjacent suffixes whose first `length`
bytes agree form a group; its smallest id is where the string starts first.

Defined results: a null text is empty; texts shorter than a window keep all
bytes; rows of equal id never remove from each other; a null id counts as later
than every other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.blocks import NULL_ID, tidied
from wayfare.llm.repeats import Search, rows_of
from wayfare.operators.ranking import global_rank
from wayfare.session import settle

U = np.uint64


def _order(keys: np.ndarray, bound: int) -> np.ndarray:
    """An order of keys (uint64, below bound). Where key and place fit into 64 bits together, they are sorted as one number."""
    bits = max(1, len(keys)).bit_length()
    if bound.bit_length() + bits > 64:
        return np.argsort(keys)
    packed = keys << U(bits)
    packed |= np.arange(len(keys), dtype=U)
    packed.sort()
    packed &= U((1 << bits) - 1)
    return packed.astype(np.int64)


def _names(keys: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    order = _order(keys, bound)
    ks = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], ks[1:] != ks[:-1]]))
    return rank, int(rank[order[-1]]) if len(keys) else 0


def difference_cover_sort(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (whole numbers from 1)."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, U)
    t[:n] = s
    top = U(int(s.max()) + 1)
    # positions of a class lie three apart, so what stands at or behind them is a slice, not a lookup
    n0, n1, n2 = (n + 2) // 3, (n + 1) // 3 + (n % 3 == 1), n // 3
    ones, twos = (lambda x, d=0: x[1 + d :: 3][:n1]), (lambda x, d=0: x[2 + d :: 3][:n2])
    if int(top) ** 3 < 2**64:
        bound = int(top) ** 3
        triple = np.concatenate([(f(t) * top + f(t, 1)) * top + f(t, 2) for f in (ones, twos)])
    else:
        pair, most = _names(np.concatenate([f(t) * top + f(t, 1) for f in (ones, twos)]), int(top) ** 2)
        bound = (most + 1) * int(top)
        triple = pair.astype(U) * top + np.concatenate([ones(t, 2), twos(t, 2)])
    name, most = _names(triple, bound)
    if most < len(name):
        order = difference_cover_sort(name)
        rank_in = np.empty(len(name), np.int64)
        rank_in[order] = np.arange(1, len(name) + 1)
    else:
        rank_in = name
        order = np.empty(len(name), np.int64)
        order[name - 1] = np.arange(len(name))
    rank = np.zeros(n + 4, U)
    ones(rank)[:], twos(rank)[:] = rank_in[:n1], rank_in[n1:]
    first = order < n1
    sorted_sample = np.where(first, order * 3 + 1, (order - n1) * 3 + 2)
    if n % 3 == 1:  # the empty suffix that was lent
        first, order, sorted_sample = (x[sorted_sample < n] for x in (first, order, sorted_sample))
    # the rest: suffixes at 0 mod 3, by their first entry and the rank that follows
    wide = U(n + 4)
    key0 = t[:n:3] * wide + rank[1::3][:n0]
    o = _order(key0, int(top) * int(wide))
    # merge: each class of the sample against the rest on keys both can form
    place1 = np.searchsorted((ones(t) * wide + ones(rank, 1))[order[first]], key0[o])
    pairs = np.concatenate([t[:n:3] * top + t[1::3][:n0], twos(t) * top + twos(t, 1)])
    if int(top) ** 2 * (n + 4) >= 2**64:
        pairs = _names(pairs, int(top) ** 2)[0].astype(U)
    place2 = np.searchsorted((pairs[n0:] * wide + twos(rank, 2))[order[~first] - n1], (pairs[:n0] * wide + rank[2::3][:n0])[o])
    out = np.empty(n, np.int64)
    at = np.arange(n0) + place1 + place2
    out[at] = o * 3
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sorted_sample
    return out


def suffix_ranks(symbols: DataFrame, max_levels: int = 40) -> DataFrame:
    """(pos, rank) of the suffixes of one string, rank from 1, by difference cover over DataFrames alone.

    symbols: (pos long, gapless from 0, v long, from 1). Sampled triples are named by a range sort over their distinct
    values; where names repeat, the string of names is ranked by recursion; the suffixes at 0 mod 3 find their place
    among each class of the sample by a range sort of keys that both can form. Every sort is a range exchange, so no
    task holds the string.
    """
    spark = symbols.sparkSession
    symbols = settle(symbols.select("pos", "v"))
    n = symbols.count()
    if max_levels == 0:
        raise RuntimeError("difference cover did not end")
    if not n:
        return symbols.select("pos", F.lit(0).cast("bigint").alias("rank"))

    def following(rows: DataFrame, names: list[str], value: str) -> DataFrame:
        """pos with value at pos, pos + 1, ... as the names; 0 behind the end."""
        shifted = rows.select(F.explode(F.array(*[F.struct((F.col("pos") - d).alias("pos"), F.lit(d).alias("d"), F.col(value).alias("x")) for d in range(len(names))])).alias("s")).select("s.*")
        return shifted.filter(f"pos >= 0 AND pos < {n}").groupBy("pos").agg(*[F.coalesce(F.max(F.when(F.col("d") == d, F.col("x"))), F.lit(0)).alias(c) for d, c in enumerate(names)])

    ahead = settle(following(symbols, ["a", "b", "c"], "v"))
    # a string whose length is 1 mod 3 lends the sample one empty suffix, so that the two classes of names stay apart
    sample = ahead.filter("pos % 3 <> 0")
    if n % 3 == 1:
        sample = sample.unionByName(spark.createDataFrame([(n, 0, 0, 0)], "pos long, a long, b long, c long"))
    sample = settle(sample)
    named = global_rank(sample.select("a", "b", "c").distinct(), ["a", "b", "c"], "name")
    names = settle(sample.join(named, ["a", "b", "c"]).select("pos", "name"))
    count, distinct = names.count(), named.count()
    ones = (n + 1) // 3 + (n % 3 == 1) if n % 3 else n // 3
    place = F.when(F.col("pos") % 3 == 1, F.expr("pos div 3")).otherwise(F.expr("pos div 3") + ones)
    if distinct == count:
        ranked = names.select("pos", F.col("name").alias("rank"))
    else:
        inner = suffix_ranks(names.select(place.alias("pos"), F.col("name").alias("v")), max_levels - 1)
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        ranked = inner.select(back.alias("pos"), "rank")
    ranked = settle(ranked)
    # the ranks that follow a position, 0 behind the end
    after = ahead.join(ranked.select((F.col("pos") - 1).alias("pos"), F.col("rank").alias("r1")), "pos", "left").join(ranked.select((F.col("pos") - 2).alias("pos"), F.col("rank").alias("r2")), "pos", "left")
    after = settle(after.select("pos", "a", "b", F.coalesce("r1", F.lit(0)).alias("r1"), F.coalesce("r2", F.lit(0)).alias("r2")))

    def placed(rows: DataFrame, key: list[str]) -> DataFrame:
        """pos, before: of the rest and one class of the sample in the order of key, how many of the other kind stand before."""
        at = global_rank(rows, key, "all")
        # all in front, less those of the own class
        own = global_rank(rows.filter(F.col("pos") % 3 == 0), key, "own").select("pos", "own").unionByName(global_rank(rows.filter(F.col("pos") % 3 != 0), key, "own").select("pos", "own"))
        return at.join(own, "pos").select("pos", (F.col("all") - F.col("own")).alias("before"))

    one = placed(after.filter("pos % 3 <> 2"), ["a", "r1"])
    two = placed(after.filter("pos % 3 <> 1"), ["a", "b", "r2"])
    rest = global_rank(after.filter("pos % 3 = 0"), ["a", "r1"], "own").select("pos", "own")
    sampled = global_rank(ranked.filter(f"pos < {n}"), ["rank"], "own").select("pos", "own")
    own = rest.unionByName(sampled)
    moved = one.unionByName(two).groupBy("pos").agg(F.sum("before").alias("before"))
    return settle(own.join(moved, "pos").select("pos", (F.col("own") + F.col("before")).alias("rank")))


def suffix_kernel(contexts: list[bytes], smallest: list[int], length: int) -> np.ndarray:
    """For each window of each context, the smallest id of a context that holds it."""
    joined = np.frombuffer(b"\0".join(contexts) + b"\0" * (length + 8), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    breaks = np.zeros(len(joined), bool)
    breaks[begin[1:] - 1] = True
    n = int(begin[-1] + sizes[-1]) if len(contexts) else 0
    s = joined[:n].astype(np.int64) + 2
    s[breaks[:n]] = 1
    order = difference_cover_sort(s)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    starts = np.repeat(begin, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(n, -1, np.int64)
    number[starts] = np.arange(len(starts))
    lined = number[order]
    lined = lined[lined >= 0]
    at = starts[lined]
    words = np.ndarray((len(joined) - 7,), np.dtype("<u8"), joined.tobytes(), 0, (1,))
    same = np.ones(max(0, len(at) - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        v = words[at + k]
        same &= v[1:] == v[:-1]
    if length < 8:
        for k in range(length):
            v = joined[at + k]
            same &= v[1:] == v[:-1]
    head = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(np.array(smallest, np.int64)[owner[lined]], head) if len(at) else np.empty(0, np.int64)
    out = np.empty(len(starts), np.int64)
    out[lined] = np.repeat(least, np.diff(np.r_[head, len(at)]))
    return out


def search(length: int = 50) -> Search:
    return Search("bytes", length, 16, suffix_kernel, refine="common", context_shard=4_000_000)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, texts: bool = False) -> DataFrame:
    """Per text: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with texts=True also kept (binary)."""
    found = search(length)
    noted = found.start(docs, id_col, text_col)

    def run(batches):
        for row in rows_of(batches):
            units, gone = found.covered(row)
            block, b = units.block, units.bounds
            ids, removed, spans, kept = [], [], [], []
            for i, (x, y) in enumerate(zip(b[:-1].tolist(), b[1:].tolist())):
                own = gone[x:y]
                n = int(np.count_nonzero(own))
                removed.append(n)
                spans.append(int(np.count_nonzero(own & ~np.r_[False, own[:-1]])) if n else 0)
                kept.append(units.raw[x:y][~own].tobytes() if n else block.text(i))
            out = {
                "id": pa.array(block.ids, pa.int64(), mask=block.ids == NULL_ID),
                "n_bytes": pa.array(np.diff(b), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
            if texts:
                out["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return noted.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)
