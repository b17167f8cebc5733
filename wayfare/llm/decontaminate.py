"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are indexed: for each term, the items that hold it with their BM25
impact, in blocks that know their largest impact. Impacts are divided by the
item's score against itself, so that one threshold fits items of any length.
Every document is cut into overlapping passages, twice as long as the longest
item and at steps of half of that, so each item that occurs lies whole in one.
Every passage queries the whole index once, by block-max WAND: the lists' best
impacts give the pivot, a pivot in a block of items whose maxima can't reach the
threshold moves on to the next block that can, the maxima of the lists' own
blocks rule out the pivot or let it be scored, and every item at or above the
threshold is returned. Items
found are verified on the text: of the item's question (its first words) and of
its answer (the rest), the share of word n-grams that the passage holds.

The index goes to all tasks in parts of at most `index_bytes` of item text; a
larger benchmark takes one pass over the documents for each part.

Defined results: words are runs of letters, digits and marks, in lower case;
null or empty texts and items match nothing; repeated rows are matched each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.blocks import tidied
from wayfare.session import settle, ship

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _parts(words: list[str], share: float) -> tuple[list[str], list[str]]:
    cut = min(len(words), max(1, round(len(words) * share)))
    return words[:cut], words[cut:]


def _ngrams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Postings with block maxima; items are numbered in the order given."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, df: dict[str, int], mean_length: float, question_share: float = 0.6, n: int = 3, block: int = 4):
        # like lengths side by side, so that a block's maxima are close to its items' impacts
        items = sorted(items, key=lambda x: len(words_of(x[1])))
        self.ids = [i for i, _ in items]
        own = [words_of(t) for _, t in items]
        self.longest = max(map(len, own), default=0)
        self.n = n
        self.question = [_ngrams(_parts(w, question_share)[0], n) for w in own]
        self.answer = [_ngrams(_parts(w, question_share)[1], n) for w in own]
        idf = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for w in own for t in w}
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, w in enumerate(own):
            tf = Counter(w)
            raw = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean_length)) for t, f in tf.items()}
            total = sum(raw.values())
            for t, x in raw.items():
                postings.setdefault(t, []).append((i, x / total))
        self.items = {t: [i for i, _ in p] for t, p in postings.items()}
        self.impact = {t: [x for _, x in p] for t, p in postings.items()}
        self.best = {t: max(x) for t, x in self.impact.items()}
        self.block = block
        #: How many pivots were passed over, and how many items were scored.
        self.skipped = self.scored = 0
        self.block_max = {t: [max(x[k : k + block]) for k in range(0, len(x), block)] for t, x in self.impact.items()}
        # the largest impact of each term for each block of items
        self.term = {t: k for k, t in enumerate(postings)}
        self.bound = np.zeros((len(postings) + 1, max(1, -(-len(items) // block))), np.float32)
        for t, p in postings.items():
            for i, x in p:
                k = self.term[t]
                self.bound[k, i // block] = max(self.bound[k, i // block], x)

    def search(self, terms: set[str], threshold: float, blocks: list[int] | None = None) -> list[tuple[int, float]]:
        """All items whose score reaches threshold, by block-max WAND. blocks: ascending blocks of items that can reach it, if known."""
        at = [[self.items[t][0], 0, t] for t in terms if t in self.items]
        found = []
        while at:
            at.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(at):
                bound += self.best[c[2]]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            if blocks is not None:
                k = bisect.bisect_left(blocks, item // self.block)
                if k == len(blocks):
                    break
                if blocks[k] > item // self.block:
                    self.skipped += 1
                    at = self._advance(at, pivot, blocks[k] * self.block)
                    continue
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            # block maxima of the lists up to the pivot, at the blocks that hold the item
            shallow, jump = 0.0, None
            for c in at[: pivot + 1]:
                own = self.items[c[2]]
                k = c[1] // self.block
                while (k + 1) * self.block < len(own) and own[(k + 1) * self.block - 1] < item:
                    k += 1
                shallow += self.block_max[c[2]][k]
                last = own[min((k + 1) * self.block, len(own)) - 1]
                jump = last + 1 if jump is None else min(jump, last + 1)
            if shallow < threshold - 1e-9:
                self.skipped += 1
                target = max(item + 1, jump)
                if pivot + 1 < len(at):
                    target = max(item + 1, min(target, at[pivot + 1][0]))
            elif at[0][0] == item:
                self.scored += 1
                score = sum(self.impact[c[2]][c[1]] for c in at[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            at = self._advance(at, pivot, target)
        return found

    def _advance(self, at: list, pivot: int, target: int) -> list:
        """The cursors up to the pivot moved to the first item from target on; those at their end are dropped."""
        left = []
        for k, c in enumerate(at):
            if k <= pivot and c[0] < target:
                own = self.items[c[2]]
                p = bisect.bisect_left(own, target, c[1])
                if p == len(own):
                    continue
                c[0], c[1] = own[p], p
            left.append(c)
        return left

    def match(self, words: list[str], threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """item number -> score, question overlap, answer overlap: the best passage of those verified."""
        get = self.term.get
        known = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        size = max(16, 2 * self.longest)
        step = size // 2
        out: dict[int, tuple[float, float, float]] = {}
        for a in range(0, max(1, len(words) - step), step):
            b = min(a + size, len(words))
            own = np.unique(known[a:b])
            reach = np.flatnonzero(self.bound[own].sum(axis=0) >= threshold - 1e-5)
            if len(reach):
                for item, score in self.search(set(words[a:b]), threshold, reach.tolist()):
                    share = self.verify(item, words[a:b])
                    if min(share) >= overlap and (item not in out or score > out[item][0]):
                        out[item] = (score, *share)
        return out

    def verify(self, item: int, words: list[str]) -> list[float]:
        """Shares of the item's question and answer n-grams that the passage holds."""
        parts = (self.question[item], self.answer[item])
        grams = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {len(next(iter(x))) for x in parts if x}}
        return [len(x & grams[len(next(iter(x)))]) / len(x) if x else 1.0 for x in parts]


def _indexes(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str, index_bytes: int, shelf_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's index in parts of bounded size, each a broadcast list of shelves."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / index_bytes))
    items = settle(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(words_of(text))
                if own:  # "" counts items, words aren't empty
                    yield pa.RecordBatch.from_pydict({"part": [part] * (len(own) + 1), "word": ["", *own], "n": [sum(own.values()), *own.values()]}, pa.schema([("part", pa.int32()), ("word", pa.string()), ("n", pa.int64())]))

    held = settle(items.select(F.col("part").cast("int"), "text").mapInArrow(words, "part int, word string, n long").groupBy("part", "word").agg(F.count("*").alias("items"), F.sum("n").alias("n")))
    total = held.filter("word = ''").agg(F.sum("items").alias("items"), F.sum("n").alias("n")).first()
    n_items, length = total["items"] or 0, total["n"] or 0
    counts = held.filter("word <> ''").groupBy("word").agg(F.sum("items").alias("df"))
    for p in range(parts):
        own = [(r["item"], r["text"]) for r in items.filter(F.col("part") == p).orderBy("item", "text").collect() if words_of(r["text"])]  # about index_bytes
        df = {r["word"]: r["df"] for r in held.filter((F.col("part") == p) & (F.col("word") != "")).join(counts, "word").select("word", "df").collect()}  # words of about index_bytes
        # shelves of some items each, so that their tables of block maxima stay small
        shelves, room = [[]], shelf_bytes
        for item in sorted(own, key=lambda x: len(x[1])):
            if shelves[-1] and len(item[1]) > room:
                shelves.append([])
                room = shelf_bytes
            shelves[-1].append(item)
            room -= len(item[1])
        yield spark.sparkContext.broadcast([Index(s, n_items, df, length / max(1, n_items)) for s in shelves if s])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.6, index_bytes: int = 8 << 20, shelf_bytes: int = 64 << 10) -> DataFrame:
    """Per verified pair: id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _indexes(spark, benchmark, item_col, item_text_col, index_bytes, shelf_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for i in range(batch.num_rows):
                    words = words_of(batch.column(1)[i].as_py())
                    found += [(i, at.ids[item], *v) for at in index.value for item, v in at.match(words, threshold, overlap).items()]
                if found:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(tidied(run), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.6, index_bytes: int = 8 << 20, shelf_bytes: int = 64 << 10) -> DataFrame:
    """The rows of docs, all columns as they were, whose text holds no verified item."""
    spark = docs.sparkSession
    ship(spark)
    text_at = docs.columns.index(text_col)
    for index in _indexes(spark, benchmark, item_col, item_text_col, index_bytes, shelf_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = []
                for i in range(batch.num_rows):
                    words = words_of(batch.column(text_at)[i].as_py())
                    clean.append(not any(at.match(words, threshold, overlap) for at in index.value))
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
