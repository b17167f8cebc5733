"""Best-fit packing: vector best-fit over token, document and attention capacities.

Texts become token ids, texts longer than a sequence are cut into pieces of full
length (the first piece may be shorter), and pieces are packed into sequences.
A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared lengths). It is filled by vector best-fit: of all lengths that fit
under every constraint, take the one with the largest weighted dot product of
the residual capacities and the demand, or the smallest weighted norm of the
residual that remains.

Pieces of one length are alike, so the fill needs only the number of pieces of
each length, at most `capacity` numbers however large the corpus is. The fill
gives patterns (lengths in one sequence, and how many sequences look like it);
each piece then finds its place from its rank among the pieces of its length.
Ranks are counted within hashed buckets, so that no length meets in one task.

Defined results: a null or empty text is one piece that holds the end token
only; repeated rows are packed each; a null id stays null.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.blocks import NULL_ID, ids_of, kept, tidied
from wayfare.session import settle, ship

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts. Pieces between single spaces are looked up, so each is encoded once.

    A single space between two characters that aren't white space always starts
    a new pre-token, so such pieces don't depend on their neighbours. Texts with
    other white space beside a space are encoded whole.
    """

    KEEP, KEEP_CHARS, SLICE = 150_000, 8 << 20, 2_000
    #: Fixed value: how byte-level BPE cuts a text into pre-tokens.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, model: str, ranks: bytes | None = None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = True
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.chars = 0
        self.fast = None
        if ranks is not None:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=table, special_tokens={})
        self.proved = False

    def _raw(self, texts: list[str]) -> list[bytes]:
        # some at a time: the library's results take far more memory than the ids
        if self.fast is None or not self.proved:
            head = texts if self.fast is None else texts[: self.SLICE]
            out = [np.array(x.ids, "<u4").tobytes() for a in range(0, len(head), self.SLICE) for x in self.model.encode_batch(head[a : a + self.SLICE], add_special_tokens=False)]
            if self.fast is None:
                return out
            if out != [array("I", self.fast.encode_ordinary(t)).tobytes() for t in head]:
                raise ValueError("the ranks are not those of the tokenizer")
            self.proved = len(head) >= 100
        return [array("I", self.fast.encode_ordinary(t)).tobytes() for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) + len(self.first) > self.KEEP or self.chars > self.KEEP_CHARS:
            self.inner.clear()
            self.first.clear()
            self.chars = 0
        split = [None if _mixed(t) else t.split(" ") for t in texts]
        new = {s for own in split if own for s in own[1:]}.difference(self.inner)
        if new:
            new = list(new)
            self.chars += sum(map(len, new))
            self.inner.update(zip(new, self._raw([" " + s for s in new])))
        new = {own[0] for own in split if own}.difference(self.first)
        if new:
            new = list(new)
            self.chars += sum(map(len, new))
            self.first.update(zip(new, self._raw(new)))
        whole = iter(self._raw([t for t, own in zip(texts, split) if own is None]))
        get = self.inner.__getitem__
        return [next(whole) if own is None else self.first[own[0]] + b"".join(map(get, own[1:])) for own in split]


_SPACE_BEFORE_SPACE = re.compile("[\\t\\r\\n\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000] ")


def _mixed(text: str) -> bool:
    """Whether white space stands before a space."""
    return "  " in text or _SPACE_BEFORE_SPACE.search(text) is not None


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, ranks: str | None = None, chunk: int = 1 << 20) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. vocabulary: path of a tokenizers file on the driver; ranks: of the same vocabulary as a tiktoken file, which encodes faster and is held against the tokenizer in each worker."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        own = f.read()
    fast = None
    if ranks:
        with open(ranks, "rb") as g:
            fast = g.read()
    model = spark.sparkContext.broadcast((own, fast))  # files of a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(model.value[0].encode())
        own = kept("packing")
        encoder = own.get(key) or own.setdefault(key, Encoder(*model.value))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = ids_of(batch.column(0))
            column = batch.column(1)
            step = max(1, int(chunk * batch.num_rows / max(1, column.nbytes)))
            out: list[list] = [[], [], [], [], []]
            for a in range(0, batch.num_rows, step):
                texts = [t or "" for t in column.slice(a, step).to_pylist()]
                for i, raw in zip(ids[a : a + step].tolist(), encoder.encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    x, piece = 0, 0
                    while x < n:
                        y = n % capacity if not piece and n % capacity else x + capacity
                        for col, v in zip(out, (i, piece, x, y - x, zlib.crc32(raw[4 * x : 4 * y]))):
                            col.append(v)
                        x, piece = y, piece + 1
            got = pa.array(out[0], pa.int64(), mask=np.array(out[0], np.int64) == NULL_ID)
            yield pa.RecordBatch.from_arrays([got, pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidied(run), PIECES).withColumnRenamed("id", id_col)


def fill(counts: dict[int, int], capacity: int = 1024, max_docs: int = 1024, max_attention: int = 1024 * 1024, rule: str = "dot") -> list[tuple[int, list[tuple[int, int]]]]:
    """Vector best-fit on the number of pieces of each length: (sequences, [(length, pieces in each)])."""
    length = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(x)] for x in length], np.int64)
    demand = np.stack([length / capacity, np.full(len(length), 1 / max_docs), length**2 / max_attention], 1)
    if len(length) and demand.max() > 1:
        raise ValueError("a piece exceeds a capacity by itself")
    weight = (demand * left[:, None]).sum(0)
    weight = weight / max(weight.sum(), 1e-12)
    patterns = []
    while left.any():
        residual, take = np.ones(3), np.zeros(len(length), np.int64)
        while True:
            fits = (left > take) & (demand <= residual + 1e-12).all(1)
            if not fits.any():
                break
            if rule == "dot":
                score = np.where(fits, demand @ (weight * residual), -np.inf)
            else:
                score = np.where(fits, -((residual - demand) ** 2 @ weight), -np.inf)
            j = len(score) - 1 - int(np.argmax(score[::-1]))
            # as many as fit while the choice stays the same length
            n = int(min(left[j] - take[j], np.floor((residual / np.maximum(demand[j], 1e-12)).min() + 1e-9)))
            n = 1 if length[j] * 2 > capacity * residual[0] else n
            take[j] += n
            residual = residual - n * demand[j]
        used = np.flatnonzero(take)
        times = int((left[used] // take[used]).min())
        left[used] -= times * take[used]
        patterns.append((times, [(int(length[j]), int(take[j])) for j in used[::-1]]))
    return patterns


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length: (first rank, end rank, first sequence, pieces in each, offset of the first)."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for times, entries in patterns:
        offset = 0
        for length, n in entries:
            lo = taken.get(length, 0)
            taken[length] = lo + times * n
            out.setdefault(length, []).append((lo, lo + times * n, base, n, offset))
            offset += length * n
        base += times
    return out


def ranked(rows: DataFrame, key: str, order: list[str], rows_in_bucket: int = 20_000) -> DataFrame:
    """rows with rank, gapless from 0 within each key, counted in hashed buckets."""
    buckets = max(256, rows.count() // rows_in_bucket)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    return inside.join(before, [key, "_bucket"]).withColumn("rank", F.col("_at") + F.col("_before")).drop("_bucket", "_at", "_before")


def best_fit_packing(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, max_docs: int | None = None, max_attention: int | None = None, rule: str = "dot", ranks: str | None = None
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    max_docs and max_attention default to what the token capacity implies, so
    that they don't cost sequences.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, vocabulary, id_col, text_col, capacity, end_id, ranks))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    lookup = places(fill(counts, capacity, max_docs or capacity, max_attention or capacity**2, rule))
    kind = "length long, segs array<struct<lo:long,hi:long,seq:long,n:long,off:long>>"
    table = F.broadcast(spark.createDataFrame(list(lookup.items()), kind))  # at most capacity rows
    out = ranked(pieces, "length", [id_col, "piece"]).join(table, "length")
    seg = F.element_at(F.filter("segs", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), 1)
    out = out.withColumn("_s", seg).withColumn("_r", F.col("rank") - F.col("_s.lo"))
    copy: Column = F.floor(F.col("_r") / F.col("_s.n"))
    return out.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_s.seq") + copy).cast("long").alias("sequence_id"),
        (F.col("_s.off") + (F.col("_r") - copy * F.col("_s.n")) * F.col("length")).cast("long").alias("offset"),
    )
