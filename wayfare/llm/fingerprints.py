"""Document fingerprints by MinHash over 5-word shingles.

Each of `permutations` universal hash functions (a * x + b mod 2**64, a odd)
maps the shingles of a text; the least value of each, cut to 16 bits, makes the
fingerprint. The share of equal places estimates the Jaccard similarity.
near_duplicates() joins bands of the signatures in Spark and verifies Jaccard.

neighbours() also fingerprints each text's edited copy: the last half of its
code points replaced by the start of the next text in order of id. For that,
texts are dealt by ranges of id; the first text of each range goes to the range
before it as well.

Defined results: words are those between ASCII white space, A-Z lower-cased; a
null text is empty; a text of fewer words than a shingle has one shingle, a text
without words none, and two texts without shingles have likeness 1; equal ids
are ordered by text; null ids come last; the last text's next is the first.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.blocks import NULL_ID, tidied
from wayfare.llm.jaccard_join import shingle_set
from wayfare.llm.repeats import U, grams, mix, words_in
from wayfare.operators.components import components
from wayfare.session import settle, ship

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TOP = U(2**64 - 1)


def multipliers(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, permutations + 1, dtype=U)
    with np.errstate(over="ignore"):
        return mix(seed * U(0x9E3779B97F4A7C15)) | U(1), mix(seed ^ U(0x5851F42D4C957F2D))


def signatures(texts: list[bytes], width: int = 5, permutations: int = 128, chunk: int = 1 << 16) -> np.ndarray:
    """uint64 array: a row for each text, the least value of each permutation; all ones for no shingles."""
    parts = []
    starts, _, h = words_in(b"\n".join(texts).translate(_LOWER))
    n = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    start = np.cumsum(n) - n
    out = np.full((len(texts), permutations), TOP)
    with np.errstate(over="ignore"):
        windows = mix(grams(h, width)) if len(h) >= width else np.empty(0, U)
        count = np.maximum(n - width + 1, 0)
        at = np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        shingles = windows[at]
        for i in np.flatnonzero((n > 0) & (n < width)).tolist():
            parts.append((i, mix(grams(h[start[i] : start[i] + n[i]], int(n[i])) + U(n[i]))))
        a, b = multipliers(permutations)
        full = np.flatnonzero(count)
        head = (np.cumsum(count) - count)[full]
        # whole texts at a time, some 2**16 shingles, so that the products stay in cache
        lo = 0
        while lo < len(full):
            hi = max(lo + 1, int(np.searchsorted(head, head[lo] + chunk)))
            end = head[hi] if hi < len(full) else len(shingles)
            x, cut = shingles[head[lo] : end], head[lo:hi] - head[lo]
            for k in range(permutations):
                out[full[lo:hi], k] = np.minimum.reduceat(x * a[k] + b[k], cut)
            lo = hi
        for i, x in parts:
            out[i] = (x[0] * a) + b
    return out


def fingerprint(signature: np.ndarray) -> np.ndarray:
    """16 bits of each least value, as big-endian uint16."""
    with np.errstate(over="ignore"):
        return (mix(signature) >> U(48)).astype(">u2")


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1)


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, permutations: int = 128, chunk: int = 1 << 20) -> DataFrame:
    """Per text: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ship(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID)))
    rows = docs.select(key.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = 4 * rows.rdd.getNumPartitions()
    edges = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], F.lit(max(10_000, 50 * ranges))).alias("e")).first()["e"] or []  # one number for each range
    edges = sorted(set(edges))
    array = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<long>")
    part = F.size(F.filter(array, lambda e: e <= F.col("k"))) if len(edges) < 64 else _range_of(edges)
    firsts = {r["p"]: r["k"] for r in rows.select("k").withColumn("p", part).groupBy("p").agg(F.min("k").alias("k")).collect()}  # a row for each range
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}
    guest = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("k")] if before else F.lit(None).cast("int")
    dealt = rows.withColumn("p", part.cast("int")).withColumn("own", F.filter(F.array(F.struct(F.col("p"), F.lit(0).alias("guest")), F.struct(guest.cast("int").alias("p"), F.lit(1).alias("guest"))), lambda x: x["p"].isNotNull()))
    dealt = dealt.select("k", "text", F.explode("own").alias("x")).select("x.p", "x.guest", "k", "text").repartition(max(1, len(order)), "p").sortWithinPartitions("p", "guest", "k", "text")

    def emit(texts: list[str], ids: list[int]) -> pa.RecordBatch:
        """texts has one more than ids: the next of the last."""
        edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
        raw = [e.encode() for e in edited]
        own = fingerprint(signatures([t.encode() for t in texts], width, permutations))
        other = fingerprint(signatures(raw, width, permutations))
        return pa.RecordBatch.from_pydict({
            "id": pa.array(ids, pa.int64(), mask=np.array(ids, np.int64) == NULL_ID),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in raw]),
            "fingerprint": pa.array([x.tobytes().hex() for x in own[:-1]]),
            "edited_fingerprint": pa.array([x.tobytes().hex() for x in other]),
            "near_edited": pa.array(likeness(own[:-1], other)),
            "near_next": pa.array(likeness(own[:-1], own[1:])),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ids: list[int] = []
        at, closed, size = None, False, 0
        for batch in batches:
            p, g, k = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(3))
            for i in range(batch.num_rows):
                if p[i] != at:
                    at, closed, texts, ids, size = p[i], False, [], [], 0
                if closed:
                    continue
                texts.append(batch.column(3)[i].as_py())
                size += len(texts[-1])
                if g[i]:
                    yield emit(texts, ids)
                    closed = True
                elif size > chunk and len(ids) > 0:
                    yield emit(texts, ids)
                    texts, ids, size = texts[-1:], [k[i]], len(texts[-1])
                else:
                    ids.append(k[i])

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)


def _range_of(edges: list[int]):
    @F.pandas_udf("int")
    def find(k: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(edges, x) for x in k.tolist()])

    return find(F.col("k"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, permutations: int = 126, bands: int = 21, threshold: float = 0.8) -> DataFrame:
    """Per text: id, class_id (least id that verified links reach; the own id of a text that links with none).

    Sets meet in buckets of equal bands: with 21 bands of 6, two sets of similarity 0.8 share one with probability 0.998.
    Equal sets count once. First each set is verified by Jaccard against the least set of its bucket. Then, in buckets
    that still hold several components, the sets outside the bucket's largest component are verified against all sets
    of other components, so every link of a bucket counts, and copies of one another aren't paired.
    """
    ship(docs.sparkSession)
    rows_in_band = permutations // bands
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def keys(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            sets = [shingle_set(t, width) for t in texts]
            sig = signatures(texts, width, permutations)
            with np.errstate(over="ignore"):
                band = sig[:, : bands * rows_in_band].reshape(len(texts), bands, rows_in_band)
                mixed = band[:, :, 0]
                for r in range(1, rows_in_band):
                    mixed = mix(mixed ^ mix(band[:, :, r]))
                mixed = mix(mixed + np.arange(bands, dtype=U)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0),
                "key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "items": pa.array([s.tobytes() for s in sets], pa.binary()),
                "bands": pa.array([b.tolist() for b in mixed], pa.list_(pa.int64())),
            })

    found = settle(rows.mapInArrow(tidied(keys), "id long, key binary, items binary, bands array<long>"))
    sets = settle(found.filter("key IS NOT NULL").groupBy("key").agg(F.first("items").alias("items"), F.first("bands").alias("bands")))
    each = sets.select("key", F.explode("bands").alias("band"))

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("key").alias("a"), F.col("items").alias("x")), sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
        near = F.least(F.length("x"), F.length("y")) >= F.greatest(F.length("x"), F.length("y")) * threshold
        return pairs.distinct().join(one, "a").join(two, "b").filter(near).filter(jaccard("x", "y") >= threshold).select("a", "b")

    least = each.groupBy("band").agg(F.min("key").alias("a"))
    links = settle(verified(each.join(least, "band").filter("key <> a").select("a", F.col("key").alias("b"))))
    comp = components(links)
    label = settle(each.join(comp.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("comp")))
    sizes = label.groupBy("band", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("main")).filter("comps > 1").select("band", "main")
    several = label.join(split, "band")
    few = several.filter("comp <> main").select("band", F.col("key").alias("p"), F.col("comp").alias("pc"), "main")
    pairs = few.join(several.select("band", "key", "comp"), "band").filter("comp <> pc AND (comp = main OR p < key)")
    links = links.unionByName(settle(verified(pairs.select(F.least("p", "key").alias("a"), F.greatest("p", "key").alias("b")))))
    comp = components(links)
    named = found.select("id", "key").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key"))
    low = named.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("class_id"))
    return named.join(low, "comp", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))
