"""Find every window of L units (words or bytes) that an earlier text holds too.

A window is L consecutive units of one text. Each text has to learn, for every
one of its windows, the smallest id of a text in which the same window starts.
The work is dealt by content, so that it grows with the corpus and not with
pairs of texts:

0. Of equal texts, only those of the smallest id are searched: another's windows
   all start in that one. Equal texts meet by a digest of 128 bits.
1. Every window has a key, the least hash of its k-unit grams. Equal windows
   have equal keys, so a key that one text alone holds rules its windows out.
   Keys are counted over all texts, pre-aggregated within each block.
2. Windows whose key is common are counted once more by the hash of the whole
   window. That drops the windows that only cross the edge of a passage. With
   refine="all" this is done for every window whose key is shared.
3. What remains is cut into contexts (the text covered by consecutive windows
   of one key) and sent to the reference shard of that key, equal contexts of a
   block only once, with the places and ids where they stand. There an exact
   kernel (a suffix automaton, a suffix array) works on the texts themselves and
   gives each window its smallest id; the answer is the places of the windows
   that start earlier.
4. Every block covers those places; it needs no keys again for that.

Hashes only route and rule out. Which windows are equal is found in step 3 from
the units themselves. No step holds more than a block or a shard of bounded
size. A key of many texts reaches a shard once for each block at most, and the
contexts of a common key are spread by a second key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.blocks import MARK, Block, expand, pack, squeeze, tidied, tidy
from wayfare.session import settle

U = np.uint64
BASE, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: A key that more texts hold than this is common.
COMMON = 256
#: Parts of a shard that the kernel works on one after the other. Contexts of one key lie in one part.
PARTS = 8
NOTE = "block long, shard int, payload binary"


def mix(x: np.ndarray, by: np.uint64 = MIX1) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= by
    x ^= x >> U(29)
    x *= MIX2
    x ^= x >> U(32)
    return x


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive entries."""
    out, have, power, size, base = None, 0, h, 1, BASE
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, have = power, size
                else:
                    n = len(h) - have - size + 1
                    out, have = out[:n] * base + power[have : have + n], have + size
            left >>= 1
            if left:
                power = power[:-size] * base + power[size:]
                size, base = size * 2, base * base
    return out


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return a if size == width else np.minimum(a[: len(a) - (width - size)], a[width - size :])


_BYTE_HASH = mix(np.arange(1, 257, dtype=U) * BASE)
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
_TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))
#: Bytes, or entries, that are worked on at a time, so that they stay in cache.
CHUNK = 1 << 15
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i below n."""
    if not _powers or len(_powers[0]) < n:
        inverse = U(pow(int(BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[U(1), np.full(max(n, 4 * CHUNK), x, U)]) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word between ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[1], _IS_SPACE[raw], [1]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(start), U)
    groups = np.unique(np.searchsorted(start, np.arange(0, len(raw) + CHUNK, CHUNK)))
    with np.errstate(over="ignore"):
        for i, j in zip(groups[:-1].tolist(), groups[1:].tolist()):
            a, b = int(start[i]), int(end[j - 1])
            power, inverse = _powers_to(b - a + 1)
            total = np.zeros(b - a + 1, U)
            np.cumsum(_BYTE_HASH[raw[a:b]] * power[: b - a], out=total[1:])
            x, y = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(U))
    return start, end, out


class Units:
    """The units of a block: their hashes, owner (text) of each, and bounds."""

    def __init__(self, block: Block, kind: str):
        self.block, self.kind = block, kind
        if kind == "words":
            self.data = b"\n".join([block.text(i) for i in range(len(block))]).translate(_TO_SPACE)
            self.start, self.end, self.hash = words_in(self.data)
            edge = np.searchsorted(self.start, block.bounds + np.arange(len(block) + 1))
            self.bounds = edge.astype(np.int64)
        else:
            self.raw = np.frombuffer(block.data, np.uint8)
            self.bounds = block.bounds
        self.size = int(self.bounds[-1])

    def hashes(self, a: int, b: int) -> np.ndarray:
        return self.hash[a:b] if self.kind == "words" else _BYTE_HASH[self.raw[a:b]]

    def content(self, a: int, b: int) -> bytes:
        if self.kind == "bytes":
            return self.block.data[a:b]
        text = self.data[self.start[a] : self.end[b - 1]]
        return b" ".join(text.split()) if b"  " in text else text


class Windows:
    """Windows of a block: start, key and owner of each, in order of start."""

    def __init__(self, units: Units, length: int, gram: int, skip: np.ndarray | None = None):
        """skip: bool of each text whose windows are left out."""
        self.units, self.length, self.gram = units, length, gram
        count = np.maximum(np.diff(units.bounds) - length + 1, 0)
        if skip is not None:
            count[skip] = 0
        self.start = np.repeat(units.bounds[:-1], count) + _ranges(count)
        self.owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.key = self._all(self._key)[self.start]

    def _all(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """f of the unit hashes of every window, some windows at a time."""
        n = max(0, self.units.size - self.length + 1)
        out = np.empty(n, U)
        with np.errstate(over="ignore"):
            for a in range(0, n, CHUNK):
                b = min(n, a + CHUNK)
                out[a:b] = f(self.units.hashes(a, b + self.length - 1))
        return out

    def _key(self, h: np.ndarray) -> np.ndarray:
        return sliding_min(mix(grams(h, self.gram)), self.length - self.gram + 1)

    def second_key(self) -> np.ndarray:
        return self._all(lambda h: sliding_min(mix(grams(h, self.gram) ^ BASE, MIX2), self.length - self.gram + 1))[self.start]

    def whole(self, chosen: np.ndarray) -> np.ndarray:
        """A hash of each chosen (bool) window, from sums over its units."""
        at = self.start[chosen]
        out = np.empty(len(at), U)
        power, inverse = _powers_to(CHUNK + self.length)
        edge = np.searchsorted(at, np.arange(0, self.units.size + CHUNK, CHUNK)).tolist()
        with np.errstate(over="ignore"):
            for k, (i, j) in enumerate(zip(edge, edge[1:])):
                if i == j:
                    continue
                a = k * CHUNK
                h = self.units.hashes(a, min(self.units.size, a + CHUNK + self.length - 1))
                total = np.zeros(len(h) + 1, U)
                np.cumsum(h * power[: len(h)], out=total[1:])
                x = at[i:j] - a
                out[i:j] = mix((total[x + self.length] - total[x]) * inverse[x])
        return out


def tally(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and for each the texts that hold it (255: or more)."""
    if not len(keys):
        return keys, np.empty(0, np.uint8)
    head = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    keys, owner = keys[head], owner[head]
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    pair = new | np.r_[True, owner[1:] != owner[:-1]]
    first = np.flatnonzero(new)
    return keys[first], np.minimum(np.add.reduceat(pair.astype(np.int64), first), 255).astype(np.uint8)


KEY_BITS = 48


def short(keys: np.ndarray) -> np.ndarray:
    """Keys of 48 bits, evenly spread. They count and rule out; that two differ is then still found by the units."""
    with np.errstate(over="ignore"):
        return mix(keys ^ BASE) >> U(64 - KEY_BITS)


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) for ascending short keys; shards are ranges of them."""
    if not len(keys):
        return []
    shard = np.minimum((keys.astype(np.float64) * (shards / 2.0**KEY_BITS)).astype(np.int64), shards - 1)
    head = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    return list(zip(shard[head].tolist(), head.tolist(), [*head[1:].tolist(), len(keys)]))


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending short keys as the bytes of their differences, byte by byte, squeezed."""
    step = np.diff(keys, prepend=U(0))
    return squeeze(step.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T.tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(KEY_BITS // 8, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, : KEY_BITS // 8] = planes.T
    return np.cumsum(step.view(U).ravel(), dtype=U)


def read_notes(notes: list | None, keys: np.ndarray, shards: int) -> np.ndarray:
    """Class of each of the ascending short keys, from the answers of the shards."""
    got = {x["shard"]: x["payload"] for x in notes or []}
    return np.concatenate([np.empty(0, np.uint8), *(np.frombuffer(expand(got[shard]), np.uint8) for shard, _, _ in by_shard(keys, shards))])


def classes_of(notes: list | None, keys: np.ndarray, shards: int) -> np.ndarray:
    """read_notes for short keys in any order, repeated ones too."""
    if not len(keys):
        return np.empty(0, np.uint8)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    out = np.empty(len(keys), np.uint8)
    out[order] = read_notes(notes, keys[new], shards)[np.cumsum(new) - 1]
    return out


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of the same length (int64), byte by byte, squeezed."""
    return squeeze(np.stack(columns).astype(np.int64).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), 1)


def unpack_numbers(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(columns, 8, -1)
    return planes.transpose(0, 2, 1).copy(order="C").view(np.int64)[:, :, 0]


def count_keys(rows: DataFrame) -> DataFrame:
    """Rows (shard, block, keys, counts) to notes: 0 one text, 1 several, 2 common."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(x) for x in pdf["keys"]]
        counts = np.concatenate([np.frombuffer(expand(x), np.uint8) for x in pdf["counts"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts)
        kind = ((total >= 2).astype(np.uint8) + (total > COMMON))[place]
        ends = np.cumsum([len(x) for x in keys])
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "payload": [squeeze(x.tobytes()) for x in np.split(kind, ends[:-1])]})

    return rows.groupBy("shard").applyInPandas(run, NOTE)


KEYS = "shard int, block long, keys binary, counts binary"
KEYS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def key_batch(block: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    parts = by_shard(keys, shards)
    return pa.RecordBatch.from_pydict(
        {
            "shard": [s for s, _, _ in parts],
            "block": [block] * len(parts),
            "keys": [pack_keys(keys[a:b]) for _, a, b in parts],
            "counts": [squeeze(counts[a:b].tobytes(), 1) for _, a, b in parts],
        },
        KEYS_ARROW,
    )


def join_notes(blocks: DataFrame, **notes: DataFrame) -> DataFrame:
    """Blocks with each kind of notes as an array of (shard, payload); the blocks stay where they are."""
    for name, rows in notes.items():
        own = rows.groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias(name))
        blocks = blocks.join(own, "block", "left")
    return blocks


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


MARKED = pa.schema([("mark", pa.binary()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("at", pa.binary())])


def later_copies(blocks: DataFrame) -> DataFrame:
    """Per block, n0: array of (least, at): places of texts that equal others, and the least id among those."""

    def marks(batches):
        for row in rows_of(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            mark = np.frombuffer(row["marks"], f"V{MARK}")
            _, place = np.unique(mark.view([("a", "<u8"), ("b", "<u8")]), return_inverse=True)
            order = np.argsort(place, kind="stable")
            head = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]]) if len(order) else order
            ends = np.r_[head[1:], len(order)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bytes(mark[order[a]]) for a in head.tolist()], pa.binary()),
                    pa.array(np.full(len(head), row["block"]), pa.int64()),
                    pa.array(np.minimum.reduceat(ids[order], head) if len(head) else ids, pa.int64()),
                    pa.array(np.maximum.reduceat(ids[order], head) if len(head) else ids, pa.int64()),
                    pa.array([order[a:b].astype(np.int32).tobytes() for a, b in zip(head.tolist(), ends.tolist())], pa.binary()),
                ],
                schema=MARKED,
            )

    rows = settle(blocks.select("block", "ids", "marks").mapInArrow(marks, "mark binary, block long, low long, high long, at binary"))
    groups = rows.groupBy("mark").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("mark", "least")
    return rows.join(groups, "mark").filter("high > least").groupBy("block").agg(F.collect_list(F.struct("least", "at")).alias("n0"))


def is_later(row: dict) -> np.ndarray:
    """bool of each text of a block: whether an equal text has a smaller id."""
    ids = np.frombuffer(row["ids"], np.int64)
    out = np.zeros(len(ids), bool)
    for x in row["n0"] or []:
        at = np.frombuffer(x["at"], np.int32)
        out[at] = ids[at] > x["least"]
    return out


class Search:
    """Steps 0 to 4 for one kind of units.

    kernel(contexts, smallest, length) gets the distinct contexts of a shard
    (bytes) and the smallest id that holds each, and returns one int64 array:
    context after context, the smallest id for each window.
    """

    def __init__(self, kind: str, length: int, gram: int, kernel: Callable, refine: str = "all", key_shard: int = 1_000_000, context_shard: int = 6_000_000):
        self.kind, self.length, self.gram, self.kernel, self.refine = kind, length, gram, kernel, refine
        self.key_shard, self.context_shard = key_shard, context_shard

    def start(self, docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
        """Pack docs, run steps 0 to 3, return blocks with all their notes."""
        blocks = pack(docs, id_col, text_col, keep=keep)
        blocks = blocks.join(settle(later_copies(blocks)), "block", "left")
        raw = blocks.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
        units = raw / (6 if self.kind == "words" else 1)
        self.s1 = max(48, math.ceil(units * 2 / (self.length - self.gram + 2) / self.key_shard))
        self.s2 = max(48, math.ceil(raw / self.context_shard))
        common = settle(count_keys(blocks.mapInArrow(tidied(self._keys()), KEYS)))
        noted = join_notes(blocks, n1=common)
        exact = settle(count_keys(noted.mapInArrow(tidied(self._whole()), KEYS)))
        noted = join_notes(blocks, n1=common, n2=exact)
        answers = settle(self._answer(noted.mapInArrow(tidied(self._contexts()), "shard int, block long, parts binary, sizes binary, runs binary, data binary")))
        return join_notes(blocks, n3=answers)

    def _keys(self):
        def run(batches):
            for row in rows_of(batches):
                w = Windows(Units(Block(row), self.kind), self.length, self.gram, is_later(row))
                yield key_batch(row["block"], *tally(short(w.key), w.owner), self.s1)

        return run

    def _asked(self, row: dict, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Class of each window's key; whether it is asked for again by the whole window."""
        if not len(w.key):
            return np.empty(0, np.uint8), np.empty(0, bool)
        head = np.flatnonzero(np.concatenate([[True], w.key[1:] != w.key[:-1]]))
        kind = classes_of(row["n1"], short(w.key[head]), self.s1)
        kind = np.repeat(kind, np.diff(np.append(head, len(w.key))))
        return kind, kind >= (1 if self.refine == "all" else 2)

    def _whole(self):
        def run(batches):
            for row in rows_of(batches):
                w = Windows(Units(Block(row), self.kind), self.length, self.gram, is_later(row))
                _, asked = self._asked(row, w)
                yield key_batch(row["block"], *tally(short(w.whole(asked)) if asked.any() else w.key[:0], w.owner[asked]), self.s1)

        return run

    def _runs(self, row: dict, w: Windows) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Contexts of a block: contents, the part of each, and of each run its context, first window and owner. PARTS parts make a shard."""
        kind, asked = self._asked(row, w)
        chosen = kind >= 1
        route = w.key
        if asked.any():
            chosen[asked] = classes_of(row["n2"], short(w.whole(asked)), self.s1) >= 1
            if (kind == 2).any():
                route = route.copy()
                route[kind == 2] = mix(w.key[kind == 2] ^ w.second_key()[kind == 2])
        at = np.flatnonzero(chosen)
        if not len(at):
            return [], at, np.empty((3, 0), np.int64)
        start, owner, route = w.start[at], w.owner[at], route[at]
        head = np.flatnonzero(np.r_[True, (route[1:] != route[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])])
        end = start[np.r_[head[1:], len(at)] - 1] + self.length
        content = w.units.content
        # equal contexts have equal windows, so they are of one part
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(content(a, b), len(known)) for a, b in zip(start[head].tolist(), end.tolist())), np.int64, len(head))
        first = np.flatnonzero(np.r_[True, which[1:] > np.maximum.accumulate(which)[:-1]])
        part = (mix(route[head[first]] ^ MIX2) % U(self.s2 * PARTS)).astype(np.int64)
        return list(known), part, np.stack([which, start[head], owner[head]])

    def _contexts(self):
        def run(batches):
            for row in rows_of(batches):
                w = Windows(Units(Block(row), self.kind), self.length, self.gram, is_later(row))
                known, part, (which, start, owner) = self._runs(row, w)
                if not known:
                    continue
                # contexts in order of part, and the runs of a shard together, in order of start
                order = np.argsort(part, kind="stable")
                part = part[order]
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                which = place[which]
                ids, home = w.units.block.ids[owner], (part // PARTS)[which]
                by = np.argsort(home, kind="stable")
                which, start, ids = which[by], start[by], ids[by]
                shards, head = np.unique(part // PARTS, return_index=True)
                ends, cuts = np.r_[head[1:], len(part)].tolist(), np.searchsorted(home[by], np.r_[shards, shards[-1] + 1]).tolist()
                for s, a, b, lo, hi in zip(shards.tolist(), head.tolist(), ends, cuts, cuts[1:]):
                    texts = [known[i] for i in order[a:b].tolist()]
                    runs = pack_numbers(which[lo:hi] - a, np.diff(start[lo:hi], prepend=0), np.diff(ids[lo:hi], prepend=0))
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([s], pa.int32()), "block": pa.array([row["block"]], pa.int64()), "parts": pa.array([np.bincount(part[a:b] % PARTS, minlength=PARTS).astype(np.int32).tobytes()], pa.binary()), "sizes": pa.array([np.array([len(x) for x in texts], np.int32).tobytes()], pa.binary()), "runs": pa.array([runs], pa.binary()), "data": pa.array([squeeze(b"".join(texts))], pa.binary())}
                    )

        return run

    def _answer(self, rows: DataFrame) -> DataFrame:
        kind, length, kernel = self.kind, self.length, self.kernel

        def windows(text: bytes) -> int:
            return (text.count(b" ") + 1 if kind == "words" else len(text)) - length + 1

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            runs = [unpack_numbers(x, 3) for x in pdf["runs"]]
            data = [expand(x) for x in pdf["data"]]
            ends = [np.cumsum(np.frombuffer(x, np.int32)) for x in pdf["sizes"]]
            cuts = [np.r_[0, np.cumsum(np.frombuffer(x, np.int32))].tolist() for x in pdf["parts"]]
            least = []
            for end, (which, start, ids) in zip(ends, runs):
                np.cumsum(start, out=start)
                np.cumsum(ids, out=ids)
                low = np.full(len(end), np.iinfo(np.int64).max)
                np.minimum.at(low, which, ids)
                least.append(low)
            # for each window of a block's contexts, the smallest id; and how many windows each context has
            answers: list[list[np.ndarray]] = [[] for _ in data]
            counts: list[list[np.ndarray]] = [[] for _ in data]
            for part in range(PARTS):
                known: dict[bytes, int] = {}
                smallest: list[int] = []
                each = []
                for r, text in enumerate(data):
                    lo, hi = cuts[r][part : part + 2]
                    a, own = int(ends[r][lo - 1]) if lo else 0, []
                    for b, low in zip(ends[r][lo:hi].tolist(), least[r][lo:hi].tolist()):
                        i = known.setdefault(text[a:b], len(known))
                        if i == len(smallest):
                            smallest.append(low)
                        elif low < smallest[i]:
                            smallest[i] = low
                        own.append(i)
                        a = b
                    each.append(np.array(own, np.int64))
                texts = list(known)
                known.clear()
                if not texts:
                    continue
                first = kernel(texts, smallest, length)
                size = np.array([windows(x) for x in texts])
                base = np.cumsum(size) - size
                for out, count, own in zip(answers, counts, each):
                    if len(own):
                        out.append(first[np.repeat(base[own], size[own]) + _ranges(size[own])])
                        count.append(size[own])
                del texts, first
            payload = []
            for out, count, (which, start, ids) in zip(answers, counts, runs):
                size = np.concatenate(count)
                base, size = (np.cumsum(size) - size)[which], size[which]
                step = _ranges(size)
                hit = (np.repeat(start, size) + step)[np.concatenate(out)[np.repeat(base, size) + step] < np.repeat(ids, size)]
                head = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                payload.append(pack_numbers(np.diff(hit[head], prepend=0), np.diff(np.r_[head, len(hit)])))
            del answers, data
            tidy()
            return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "payload": payload})

        return rows.groupBy("shard").applyInPandas(run, NOTE)

    def covered(self, row: dict) -> tuple[Units, np.ndarray]:
        """Units of a block, and which of them an earlier text's window covers."""
        units = Units(Block(row), self.kind)
        later = is_later(row)
        edge = np.zeros(units.size + 1, np.int32)
        found = [unpack_numbers(x["payload"], 2) for x in row["n3"] or []]
        if found:
            start = np.concatenate([np.cumsum(x) for x, _ in found])
            edge += np.bincount(start, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(start + np.concatenate([n for _, n in found]) + (self.length - 1), minlength=len(edge)).astype(np.int32)
        gone = np.cumsum(edge[:-1]) > 0
        for i in np.flatnonzero(later & (np.diff(units.bounds) >= self.length)).tolist():
            gone[units.bounds[i] : units.bounds[i + 1]] = True
        return units, gone


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
