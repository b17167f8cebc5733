"""Substring dedup: suffix automata of reference shards and matching statistics.

Every passage that several texts share goes, by its content, to one reference
shard. The shard's suffix automaton is built where its passages meet, and each
text's passages stream through it: the matching statistic at a word tells
whether a window of the threshold's length ends there, and the automaton's state
holds the smallest id in which that window starts. Maximal spans above the
threshold are then removed from all texts but the first that holds them.

The automata aren't broadcast to all tasks, because together they grow with the
corpus; a shard's size is bounded and each text visits only the shards that its
own passages name.

Defined results: a null or empty text has no words; texts shorter than a window
keep everything; rows of equal id never remove from each other; a null id counts
as later than every other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.blocks import NULL_ID, tidied
from wayfare.llm.repeats import Search, Units, rows_of


def automaton_kernel(contexts: list[bytes], smallest: list[int], length: int) -> np.ndarray:
    """For each window of each context (words joined by a space), the smallest id of a context that holds it."""
    number: dict[bytes, int] = {}
    symbols = [[number.setdefault(w, len(number)) for w in c.split(b" ")] for c in contexts]
    follow: list[dict[int, int]] = [{}]
    link, size, least = [-1], [0], [NULL_ID]
    for own, low in zip(symbols, smallest):
        last = 0
        for w in own:
            there = follow[last].get(w)
            if there is not None and size[there] == size[last] + 1:
                last = there
            else:
                if there is None:
                    state = len(size)
                    follow.append({})
                    size.append(size[last] + 1)
                    link.append(0)
                    least.append(NULL_ID)
                    p = last
                    while p != -1 and w not in follow[p]:
                        follow[p][w] = state
                        p = link[p]
                    target = 0
                    if p != -1:
                        q = follow[p][w]
                        target = q if size[q] == size[p] + 1 else _clone(follow, link, size, least, p, q, w)
                    link[state] = target
                    last = state
                else:
                    last = _clone(follow, link, size, least, last, there, w)
            if low < least[last]:
                least[last] = low
    for state in np.argsort(np.array(size), kind="stable")[:0:-1].tolist():
        up = link[state]
        if least[state] < least[up]:
            least[up] = least[state]
    out = []
    for own in symbols:
        state = match = 0
        for w in own:
            while state and w not in follow[state]:
                state = link[state]
                match = size[state]
            if w in follow[state]:
                state = follow[state][w]
                match += 1
            while size[link[state]] >= length:
                state = link[state]
                match = size[state]
            if match >= length:
                out.append(least[state])
    return np.array(out, np.int64)


def _clone(follow, link, size, least, p, q, w) -> int:
    """A copy of state q that is reached from p by w with the shorter length."""
    state = len(size)
    follow.append(dict(follow[q]))
    size.append(size[p] + 1)
    link.append(link[q])
    least.append(NULL_ID)
    link[q] = state
    while p != -1 and follow[p].get(w) == q:
        follow[p][w] = state
        p = link[p]
    return state


def search(length: int = 13) -> Search:
    return Search("words", length, 5, automaton_kernel, refine="all", context_shard=4_000_000)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """Per text: id, n_words, n_removed, kept_sha256 (lowercase hex of the kept words joined by a space)."""
    found = search(length)
    noted = found.start(docs, id_col, text_col)

    def run(batches):
        for row in rows_of(batches):
            units, gone = found.covered(row)
            block, b = units.block, units.bounds
            removed, kept = _kept(units, gone)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(block.ids, pa.int64(), mask=block.ids == NULL_ID),
                "n_words": pa.array(np.diff(b), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            })

    return noted.mapInArrow(tidied(run), "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def _kept(units: Units, gone: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Words removed from each text, and its kept words joined by a space."""
    b = units.bounds
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[b[1:]] - total[b[:-1]]
    return removed, [b" ".join(compress(units.block.text(i).split(), (~gone[x:y]).tolist()) if n else units.block.text(i).split()) for i, (x, y, n) in enumerate(zip(b[:-1].tolist(), b[1:].tolist(), removed.tolist()))]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, length: int = 13) -> DataFrame:
    """docs with shared passages left in their first text only, all columns as they were.

    A text that loses words is its kept words joined by a space, and length_col,
    if given, its new number of characters. A text that loses all words is dropped.
    """
    found = search(length)
    noted = found.start(docs, id_col, text_col, keep=[c for c in docs.columns if c != text_col])
    schema = docs.schema

    def run(batches):
        for row in rows_of(batches):
            units, gone = found.covered(row)
            removed, kept = _kept(units, gone)
            block = units.block
            texts = [None if block.null[i] else (kept[i] if n else block.text(i)).decode() for i, n in enumerate(removed)]
            rest = iter(block.rest().columns)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else next(rest) for f in schema.fields]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(removed > 0)], names=[f"c{i}" for i in range(len(columns) + 1)])
            yield batch.filter(pa.array([bool(k) or not n for k, n in zip(kept, removed)]))

    fields = ", ".join(f"c{i} {f.dataType.simpleString() if f.name != text_col else 'string'}" for i, f in enumerate(schema.fields)) + f", c{len(schema.fields)} boolean"
    out = noted.mapInArrow(tidied(run), fields)
    changed = F.col(f"c{len(schema.fields)}")
    text = F.col(f"c{docs.columns.index(text_col)}")
    return out.select(*[(F.when(changed, F.length(text)).otherwise(F.col(f"c{i}")).cast(f.dataType) if f.name == length_col else F.col(f"c{i}")).alias(f.name) for i, f in enumerate(schema.fields)])
