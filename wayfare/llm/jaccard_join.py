"""N-gram Jaccard join by T-occurrence search (DivideSkip), with exact results.

A document's set holds its distinct 5-word shingles. Two documents link when
their sets' Jaccard similarity reaches num/den. The result gives each document
its set size and the least id that links reach.

1. Filter. A set of n shingles can miss at most n - ceil(n * num / den) of them
   in a partner. So of its shingles that come first in hash order, a share must
   occur in other sets too; documents below that share have no links.
2. Equal sets become one class, which has a key of its own; links join keys.
3. Hub search. Each class sends its set to the least member of its MinHash
   buckets. A shard holds an inverted index of the sets sent to it and runs the
   T-occurrence search with every hub as query.
4. The links so far form components. A link that is still missing joins two
   components, so only shingles that occur in several components matter, and
   only documents that have enough of those. Their sets are split by hash into
   segments of 16 to 32 shingles; the larger of two linked sets decides how many
   segments a pair has, so a set near a power of two takes two divisions. Of two
   linked sets, at least one segment reaches the required share too, so the
   search runs on segments: each goes to the shards of its rarest shared shingles
   (one of which any partner has) and queries the inverted index there. Take the
   segments as a ring: of two linked sets, some segment reaches the share together
   with any number of those that follow it. So a row carries a parity bitmap of
   its segment and the next fifteen; bits that differ never outnumber shingles that
   differ, which rules out most pairs, whatever the size of the sets. Of the rest a
   shard lists a spanning forest over the components, closest pairs first; those
   are verified on the whole sets, and components that link are merged. Where a
   listed pair did not link, the components of its group there go again with 64 times as many forests,
   until every pair is verified or inside one component. So large groups that link
   cost their number of components, not the product of their sizes.
5. Components of all links; the least id of a component's rows is its name.

Steps 3 and 4 use the same search: of a query's inverted lists, DivideSkip puts
the longest aside, merges the short ones with a heap, keeps documents that reach
the reduced count, and probes the long lists by binary search. Overlaps are then
exact. Step 3 only keeps step 4 small; step 4 leaves no pair out.

Defined results: null texts and texts without words have an empty set and link
with nothing; texts of fewer words than a shingle have one, the whole sequence;
repeated rows get one result each; a null id counts as larger than all others.
Rows are told apart by their place, not by their id: null ids, or one id with
several texts, link nothing by themselves.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.blocks import NULL_ID, Block, by_key, expand, pack, release, squeeze, tidied, tidy
from wayfare.llm.repeats import KEYS, U, classes_of, count_keys, grams, join_notes, key_batch, mix, rows_of, short, words_in
from wayfare.operators.components import components
from wayfare.session import settle

BANDS, ROWS = 8, 3
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes (64 bits) of its shingles."""
    starts, _, h = words_in(b"\n".join(texts).translate(_LOWER))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    out = []
    with np.errstate(over="ignore"):
        full = mix(grams(h, width) + U(width)) if len(h) >= width else np.empty(0, U)
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= width:
                own = np.sort(full[a : b - width + 1])
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                out.append(own[new])
            else:
                out.append(mix(grams(h[a:b], b - a) + U(b - a)) if b > a else np.empty(0, U))
    return out


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    return shingle_sets([text], width)[0]


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-n * num // den)


def _prefix(n: int, num: int, den: int) -> int:
    """How many of n shingles, first in hash order, are counted over the corpus."""
    return min(n, n - least_overlap(n, num, den) + max(1, -(-n // 10)))


def _needed(n: int, num: int, den: int) -> int:
    """How many of the prefix a partner's prefix holds too, at least."""
    smallest = max(1, least_overlap(n, num, den))
    return max(1, min(_prefix(n, num, den) - (n - least_overlap(n, num, den)), _prefix(smallest, num, den) - (smallest - least_overlap(smallest, num, den))))


def divide_skip(lists: list[list[int]], need: int, mu: float = 0.01) -> dict[int, int]:
    """Ids that occur in at least `need` of the ascending lists, with their number of occurrences."""
    if need < 1 or len(lists) < need:
        return {}
    lists = sorted(lists, key=len)
    long_most = min(need - 1, int(need / (mu * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - long_most], lists[len(lists) - long_most :]
    counts: dict[int, int] = {}
    run, n, floor = None, 0, need - len(long)
    for x in heapq.merge(*short):
        if x == run:
            n += 1
            continue
        if run is not None and n >= floor:
            counts[run] = n
        run, n = x, 1
    if run is not None and n >= floor:
        counts[run] = n
    out = {}
    for x, n in counts.items():
        left = len(long)
        for own in long:
            if n + left < need:
                break
            left -= 1
            i = bisect.bisect_left(own, x)
            n += i < len(own) and own[i] == x
        if n >= need:
            out[x] = n
    return out


def search_lists(sets: list[list[int]], queries: Iterable[int], need: list[int], later: bool = False) -> Iterator[tuple[int, int, int]]:
    """(query, other, shared) of positions in sets that share at least need[query] entries; with later, of others behind the query."""
    index: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        for x in own:
            index.setdefault(x, []).append(i)
    for q in queries:
        lists = [index[x] for x in sets[q] if len(index[x]) > 1]
        if later:
            lists = [own[bisect.bisect_right(own, q) :] for own in lists if own[-1] > q]
        for other, shared in divide_skip(lists, need[q]).items():
            if other != q:
                yield q, other, shared


def linked(n: int, m: int, shared: int, num: int, den: int) -> bool:
    return den * shared >= num * (n + m - shared)


def _bands(items: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        low = np.array([(items * a).min() for a in _A], U).reshape(BANDS, ROWS)
        key = low[:, 0].copy()
        for r in range(1, ROWS):
            key = mix(key ^ mix(low[:, r]))
        return mix(key + np.arange(BANDS, dtype=U)).view(np.int64).tolist()


#: Shingles in a segment, at least; bits of a parity bitmap; segments in it.
SEGMENT, BITS, CHAIN = 16, 512, 16
#: Shards that a row of a later round names, at most; where a component has more, its rows go to all of theirs.
NAMED = 256
#: Rows of a block, at most, so that block and place make one number.
PLACES = 1 << 20


def divisions(n: int, num: int, den: int) -> set[int]:
    """Numbers of segments in which a set of n meets any partner of its size or larger, or smaller."""
    return {1 << max(0, (m // SEGMENT).bit_length() - 1) for m in (n, n * den // num)}


def parities(items: np.ndarray, segment: np.ndarray, count: int) -> np.ndarray:
    """For each of count segments, the parity bitmap (words of 64 bits) of its items and those of the segments behind it on the ring, CHAIN in all."""
    bit = mix(items + U(7)) % U(BITS)
    own = np.zeros((count, BITS // 64), U)
    np.bitwise_xor.at(own, (segment, (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    return np.broadcast_to(np.bitwise_xor.reduce(own, axis=0), own.shape) if count <= CHAIN else _chained(own, np.bitwise_xor)


def _chained(own: np.ndarray, op: np.ufunc) -> np.ndarray:
    """op over each entry and the CHAIN - 1 behind it on a ring that is longer; doubles the reach, as CHAIN is a power of two."""
    reach = 1
    while reach < CHAIN:
        own = op(own, np.roll(own, -reach, axis=0))
        reach *= 2
    return own


def chain_sizes(sizes: np.ndarray) -> np.ndarray:
    return np.full(len(sizes), sizes.sum()) if len(sizes) <= CHAIN else _chained(sizes, np.add)


class Forests:
    """Of edges between components, at most k spanning forests, edges of low weight first."""

    def __init__(self, comps: np.ndarray, k: int, batch: int = 200_000):
        self.names, self.of = np.unique(comps, return_inverse=True)
        self.k, self.batch = k, batch
        self.edges = np.empty((4, 0), np.int64)  # a, b, and the components' places
        self.weights = np.empty(0)
        self.label = np.arange(len(self.names))
        self.most = np.full(len(self.names), np.inf)
        self.waiting: list[tuple] = []
        self.held = 0
        self.suppressed = False

    def open(self, i: int, others: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Which edges may still enter; the others lie inside one group of the last forest and weigh as much as its heaviest edge."""
        mine = self.label[self.of[i]]
        new = (self.label[self.of[others]] != mine) | (weight < self.most[mine])
        self.suppressed |= not new.all()
        return new

    def add(self, a: np.ndarray, b: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> None:
        self.waiting.append((np.stack([a, b, one, two]), weight))
        self.held += len(a)
        if self.held >= self.batch:
            self.settle()

    def settle(self) -> None:
        edges = np.concatenate([self.edges, *(e for e, _ in self.waiting)], axis=1)
        weights = np.concatenate([self.weights, *(w for _, w in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.lexsort((edges[1], edges[0], weights))
        edges, weights = edges[:, order], weights[order]
        _, first = np.unique(edges[:2], axis=1, return_index=True)
        first.sort()
        edges, weights = edges[:, first], weights[first]
        up: list[list[int]] = []

        def find(tree: list[int], x: int) -> int:
            while tree[x] != x:
                tree[x] = tree[tree[x]]
                x = tree[x]
            return x

        keep = []
        for j, (x, y) in enumerate(zip(edges[2].tolist(), edges[3].tolist())):
            lo, hi = 0, len(up)  # whoever is joined in a forest is so in all before it
            while lo < hi:
                mid = (lo + hi) // 2
                if find(up[mid], x) == find(up[mid], y):
                    lo = mid + 1
                else:
                    hi = mid
            if lo == self.k:
                self.suppressed = True
                continue
            if lo == len(up):
                up.append(list(range(len(self.names))))
            up[lo][find(up[lo], x)] = find(up[lo], y)
            keep.append(j)
        self.edges, self.weights = edges[:, keep], weights[keep]
        # what the first forest joins; all pairs between components, listed or held back, lie inside one group
        self.group = np.array([find(up[0], x) for x in self.edges[2].tolist()], np.int64) if up else np.empty(0, np.int64)
        if len(up) == self.k:
            self.label = np.array([find(up[-1], x) for x in range(len(self.names))])
            self.most = np.full(len(self.names), -np.inf)
            np.maximum.at(self.most, self.label[self.edges[2]], self.weights)


def _hub_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows (shard, id, hub, items) to links (a, b): every hub queries the index of its shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        sets = [np.frombuffer(x, U).tolist() for x in pdf["items"]]
        need = [least_overlap(len(s), num, den) for s in sets]
        found = search_lists(sets, np.flatnonzero(pdf["hub"].to_numpy()).tolist(), need)
        pairs = [(ids[q], ids[o]) for q, o, n in found if linked(len(sets[q]), len(sets[o]), n, num, den)]
        del sets, found
        tidy()
        return pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype="int64")

    return rows.groupBy("shard").applyInPandas(run, "a long, b long")


def _segment_pairs(rows: DataFrame, num: int, den: int, forests: int) -> DataFrame:
    """rows (shard, id, comp, n, parity, chain, size, items), one for a segment, to pairs (shard, a, b, group, more) of different components that may link.

    Segments with the same items count as one in the search. A pair that links
    has a segment that links by itself and with the chain behind it, so sizes and
    bitmaps are compared there. Items are 32 bits of the shingles' hashes: where two meet in one, a pair shares
    more than it does, never less. A shard lists at most so many spanning forests over
    its components, and which pairs are connected there (group); more tells whether it has held pairs back.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], kind="stable")
        ids, comps, n, size, chain = (pdf[c].to_numpy(np.int64) for c in ("id", "comp", "n", "size", "chain"))
        bits = np.frombuffer(b"".join(pdf["parity"]), U).reshape(len(pdf), -1)
        same: dict[bytes, list[int]] = {}
        for i, x in enumerate(pdf["items"]):
            same.setdefault(x, []).append(i)
        sets = [np.frombuffer(x, np.uint32).tolist() for x in same]
        members = [np.array(x) for x in same.values()]
        lone = [int(comps[x[0]]) if (comps[x] == comps[x[0]]).all() else None for x in members]
        need = [least_overlap(int(size[x].min()), num, den) for x in members]
        found = Forests(comps, forests)
        # what one component alone holds here can't be shared by two
        holder: dict[int, int | None] = {}
        for items, comp in zip(sets, lone):
            for x in items:
                if holder.setdefault(x, comp) != comp:
                    holder[x] = None
        shared_sets = [[x for x in items if holder[x] is None] for items in sets]
        asking = [i for i, x in enumerate(shared_sets) if len(x) >= need[i]]

        def check(own: np.ndarray, others: np.ndarray, shared: int) -> None:
            for i in own.tolist():
                lo, hi = np.searchsorted(n[others], [-(-n[i] * num // den), n[i] * den // num + 1])
                x = others[lo:hi]
                x = x[(comps[x] != comps[i]) & (den * shared >= num * (size[x] + size[i] - shared))]
                if len(x):
                    apart = np.bitwise_count(bits[x] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    both = chain[x] + chain[i]
                    near = apart * (num + den) <= both * (den - num)
                    x, weight = x[near], (apart / both)[near]
                    new = found.open(i, x, weight)
                    x, weight = x[new], weight[new]
                if len(x):
                    found.add(np.minimum(ids[x], ids[i]), np.maximum(ids[x], ids[i]), found.of[x], np.full(len(x), found.of[i]), weight)

        for own, items, comp in zip(members, sets, lone):
            if comp is None:
                check(own, own, len(items))
        for q, o, shared in search_lists(shared_sets, asking, need, later=True):
            if lone[q] is None or lone[q] != lone[o]:
                check(*sorted((members[q], members[o]), key=len), shared)
        found.settle()
        out = pd.DataFrame({"shard": pdf["shard"].iloc[0], "a": found.edges[0], "b": found.edges[1], "group": found.group, "more": found.suppressed})
        del sets, shared_sets, holder, members, bits, found
        tidy()
        return out

    return rows.groupBy("shard").applyInPandas(run, "shard int, a long, b long, group long, more boolean")


def _rows_again(rest: DataFrame, comp: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of rest (bucketed by id) whose component is in again (shard, comp), with the present component and to, its shards there (null: all).

    Ids are looked up by component and joined to the rows, so that the sets stay where they are and segments are sent
    to those shards only. A row too many lists nothing wrong: all that is listed is verified.
    """
    to = again.groupBy("comp").agg(F.collect_set("shard").alias("to")).select("comp", F.when(F.size("to") <= NAMED, F.col("to")).alias("to"))
    members = comp.filter("node <> component").select(F.col("node").alias("id"), F.col("component").alias("comp")).join(to, "comp").select("id", "comp", "to")
    members = members.unionByName(to.select(F.col("comp").alias("id"), "comp", "to"))  # a component's name is its least member
    return rest.drop("comp").join(members, "id").select(*rest.columns, "to")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: id, n_shingles, component_id."""
    _, out = _solve(docs, id_col, text_col, width, num, den)
    null = F.lit(int(NULL_ID))
    return out.select(F.nullif("id", null).alias(id_col), "n_shingles", F.nullif("component_id", null).alias("component_id"))


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns as they were, of which one stays for each component: the first row of its least id. Rows that link with none stay, whatever their ids."""
    blocks, out = _solve(docs, id_col, text_col, width, num, den, [c for c in docs.columns if c != text_col])
    first = out.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("id", "block", "at")).alias("x")).select("x.block", "x.at")
    stay = first.unionByName(out.filter("comp IS NULL").select("block", "at")).groupBy("block").agg(F.collect_list("at").alias("stay"))
    schema = docs.schema

    def run(batches):
        for row in rows_of(batches):
            block = Block(row)
            at = sorted(row["stay"])
            rest = iter(block.rest().take(pa.array(at)).columns)
            texts = pa.array([None if block.null[i] else block.text(i).decode() for i in at], pa.string())
            yield pa.RecordBatch.from_arrays([texts if f.name == text_col else next(rest) for f in schema.fields], names=[f"c{i}" for i in range(len(schema.fields))])

    fields = ", ".join(f"c{i} {f.dataType.simpleString() if f.name != text_col else 'string'}" for i, f in enumerate(schema.fields))
    return blocks.join(stay, "block").mapInArrow(tidied(run), fields).toDF(*docs.columns)


def _solve(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, keep: list[str] | None = None, shard_items: int = 1_500_000) -> tuple[DataFrame, DataFrame]:
    """The packed blocks, and per document: block, at, id, n_shingles, component_id, and comp (a key of its component; null for rows that link with none)."""
    blocks = pack(docs, id_col, text_col, keep=keep)
    raw = blocks.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
    shards = max(48, math.ceil(raw / 6 * 0.35 / 1_000_000))
    # sets and those that search by segments are joined by id several times
    stored = [f"{kind}_{uuid.uuid4().hex}" for kind in ("sets", "rest")]

    def block_sets(row: dict):
        block = Block(row)
        return block, shingle_sets([block.text(i) for i in range(len(block))], width)

    def prefixes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cut = [s[: _prefix(len(s), num, den)] for s in sets]
        keys = np.concatenate([*cut, np.empty(0, U)])
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        return keys, owner

    def first(batches):
        for row in rows_of(batches):
            _, sets = block_sets(row)
            keys, owner = prefixes(sets)
            keys = short(keys)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
            at = np.flatnonzero(new)
            counts = np.minimum(np.diff(np.r_[at, len(keys)]), 255).astype(np.uint8)
            yield key_batch(row["block"], keys[at], counts, shards)

    def second(batches):
        for row in rows_of(batches):
            block, sets = block_sets(row)
            if len(sets) > PLACES:
                raise ValueError(f"{len(sets)} rows in one block")
            keys, owner = prefixes(sets)
            shared = classes_of(row["n1"], short(keys), shards) >= 1
            count = np.bincount(owner, weights=shared, minlength=len(sets))
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([row["block"]] * len(sets), pa.int64()),
                "at": pa.array(range(len(sets)), pa.int32()),
                "id": pa.array(block.ids, pa.int64()),
                "n": pa.array(n, pa.int64()),
                "class": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and c >= _needed(len(s), num, den) else None for s, c in zip(sets, count)], pa.binary()),
            })

    common = settle(count_keys(blocks.mapInArrow(tidied(first), KEYS)))
    found = settle(join_notes(blocks, n1=common).mapInArrow(tidied(second), "block long, at int, id long, n long, class binary"))
    # one document stands for each class of equal sets; its place is the key of the class, as ids may be null or repeated
    classes = settle(found.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "block", "at")).alias("x")).select("class", "x.*", (F.col("x.block") * PLACES + F.col("x.at")).alias("key")))

    def third(batches):
        for row in rows_of(batches):
            if not row["chosen"]:
                continue
            block = Block(row)
            at = sorted(row["chosen"])
            sets = shingle_sets([block.text(i) for i in at], width)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([row["block"] * PLACES + i for i in at], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "items": pa.array([s.tobytes() for s in sets], pa.binary()),
                "bands": pa.array([_bands(s) for s in sets], pa.list_(pa.int64())),
            })

    chosen = classes.groupBy("block").agg(F.collect_list("at").alias("chosen"))
    sets = by_key(blocks.join(chosen, "block").mapInArrow(tidied(third), "id long, n long, items binary, bands array<long>"), "id", stored[0])
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # hub search
    keys = sets.select("id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    pairs = keys.join(hubs, "key").filter("id <> hub").groupBy("hub", "id").agg(F.max("m").alias("m"))
    groups = max(48, math.ceil(2 * total / shard_items))
    salted = pairs.select("hub", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / 300)).alias("salt"))
    placed = salted.select(F.pmod(F.xxhash64("hub", "salt"), F.lit(groups)).cast("int").alias("shard"), F.explode(F.array(F.struct("id", F.lit(False).alias("hub")), F.struct(F.col("hub").alias("id"), F.lit(True).alias("hub")))).alias("x"))
    placed = placed.groupBy("shard", "x.id").agg(F.max("x.hub").alias("hub"))
    links = settle(_hub_links(placed.join(sets.select("id", "items"), "id"), num, den))
    comp = settle(components(links))

    # shingles that several components hold
    labelled = sets.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "items")
    parts = max(48, math.ceil(total / 1_000_000))

    def deal(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                own = batch.slice(a, 1000)
                ids, comps = own.column(0).to_numpy(), own.column(1).to_numpy()
                items = [np.frombuffer(x.as_py(), U) for x in own.column(2)]
                keys = np.concatenate([*items, np.empty(0, U)])
                owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
                shard = (mix(keys) % U(parts)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                keys, owner = keys[order], owner[order]
                edge = np.searchsorted(shard[order], np.arange(parts + 1)).tolist()
                cuts = [(s, x, y) for s, (x, y) in enumerate(zip(edge, edge[1:])) if y > x]
                out = {"shard": [], "ids": [], "comps": [], "counts": [], "keys": []}
                for s, x, y in cuts:
                    who, n = np.unique(owner[x:y], return_counts=True)
                    for name, v in (("shard", s), ("ids", squeeze(ids[who].tobytes(), 1)), ("comps", squeeze(comps[who].tobytes(), 1)), ("counts", squeeze(n.astype(np.int32).tobytes(), 1)), ("keys", keys[x:y].tobytes())):
                        out[name].append(v)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(out["shard"], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items() if k != "shard"}})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(expand(x), np.int64) for x in pdf["ids"]])
        comps = np.concatenate([np.frombuffer(expand(x), np.int64) for x in pdf["comps"]])
        counts = np.concatenate([np.frombuffer(expand(x), np.int32) for x in pdf["counts"]])
        keys = np.concatenate([np.frombuffer(x, U) for x in pdf["keys"]])
        who = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((comps[who], keys))
        k, c = keys[order], comps[who][order]
        new = np.r_[True, k[1:] != k[:-1]]
        pair = new | np.r_[True, c[1:] != c[:-1]]
        at = np.flatnonzero(new)
        several = np.add.reduceat(pair.astype(np.int64), at) > 1
        df = np.diff(np.r_[at, len(k)])
        often = np.zeros(len(keys), np.uint32)
        often[order] = np.repeat(np.where(several, df, 0), df)
        # a set's keys lie together here, in order: their places say which they are
        picked = np.flatnonzero(often)
        place = (picked - (np.cumsum(counts) - counts)[who[picked]]).astype(np.uint32)
        owners, start = np.unique(who[picked], return_index=True)
        shard, often = np.array([pdf["shard"].iloc[0]], np.uint32), often[picked]
        notes = [np.concatenate([shard, place[x:y], often[x:y]]).tobytes() for x, y in zip(start, np.r_[start[1:], len(picked)])]
        return pd.DataFrame({"id": ids[owners], "note": notes})

    dealt = labelled.mapInArrow(tidied(deal), "shard int, ids binary, comps binary, counts binary, keys binary")
    # a note: its shard, places of the set's keys among those there, and how many sets hold each
    partial = dealt.groupBy("shard").applyInPandas(across, "id long, note binary")
    counted = partial.withColumn("m", ((F.length("note") - 4) / 8).cast("long"))
    rest = counted.groupBy("id").agg(F.sum("m").alias("m"), F.collect_list("note").alias("notes"))
    rest = by_key(rest.join(labelled.select("id", "comp", "items"), "id").filter(F.col("m") >= F.ceil(F.length("items") / 8 * num / den - 1e-6)), "id", stored[1])
    size = rest.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    if size:
        few = max(48, math.ceil(3 * size / shard_items))

        def route(batches):
            for row in rows_of(batches):
                whole, named = np.frombuffer(row["items"], U), row.get("to") and set(row["to"])
                home = (mix(whole) % U(parts)).astype(np.int64)
                by = np.argsort(home, kind="stable")
                notes = [np.frombuffer(x, np.uint32) for x in row["notes"]]
                first_of = np.searchsorted(home[by], [x[0] for x in notes])
                keys = whole[by[np.concatenate([x[1 : len(x) // 2 + 1] + at for x, at in zip(notes, first_of)])]]
                often = np.concatenate([x[len(x) // 2 + 1 :] for x in notes])
                keys = keys[np.lexsort((keys, often))]
                out = []
                for count in divisions(len(whole), num, den):
                    place = (mix(whole) % U(count)).astype(np.int64)
                    sizes = np.bincount(place, minlength=count)
                    bits, chains = parities(whole, place, count), chain_sizes(sizes).tolist()
                    sizes = sizes.tolist()
                    segment = (mix(keys) % U(count)).astype(np.int64)
                    order = np.argsort(segment, kind="stable")
                    edge = np.searchsorted(segment[order], np.arange(count + 1)).tolist()
                    for s in range(count):
                        own = keys[order[edge[s] : edge[s + 1]]]
                        need = least_overlap(sizes[s], num, den)
                        if sizes[s] and len(own) >= need:
                            own = mix(own + U(count))
                            sent = (own >> U(32)).astype(np.uint32).tobytes()
                            for to in set((own[: len(own) - need + 1] % U(few)).tolist()):
                                if named is None or to in named:
                                    out.append((to, sizes[s], sent, chains[s], bits[s].tobytes()))
                if out:
                    m = len(out)
                    shard, size, items, chain, bits = zip(*out)
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "id": pa.array([row["id"]] * m, pa.int64()), "comp": pa.array([row["comp"]] * m, pa.int64()), "n": pa.array([len(whole)] * m, pa.int64()), "parity": pa.array(bits, pa.binary()), "chain": pa.array(chain, pa.int64()), "size": pa.array(size, pa.int32()), "items": pa.array(items, pa.binary())})

        @F.pandas_udf("boolean")
        def verified(x: pd.Series, y: pd.Series) -> pd.Series:
            out = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p, U), np.frombuffer(q, U)
                out.append(linked(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True)), num, den))
            return pd.Series(out, dtype=bool)

        one = rest.select(F.col("id").alias("a"), F.col("items").alias("x"))
        two = rest.select(F.col("id").alias("b"), F.col("items").alias("y"))
        near = F.least(F.length("x"), F.length("y")) * den >= F.greatest(F.length("x"), F.length("y")) * num
        forests, again = 1, None
        while True:
            rows = rest if again is None else _rows_again(rest, comp, again)
            routed = rows.mapInArrow(tidied(route), "shard int, id long, comp long, n long, parity binary, chain long, size int, items binary")
            listed = settle(_segment_pairs(routed, num, den, forests))
            pairs = listed.select("a", "b").distinct()
            more = settle(pairs.join(one, "a").join(two, "b").filter(near).filter(verified("x", "y")).select("a", "b"))
            links = links.unionByName(more)
            comp = settle(components(links))
            # a pair that was held back lies inside a group of its shard; where all pairs listed there now are in one component, so is that one
            now = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"comp_{x}"))
            ends = listed.filter("more").join(now("a"), "a", "left").join(now("b"), "b", "left").select("shard", "group", F.coalesce("comp_a", "a").alias("comp_a"), F.coalesce("comp_b", "b").alias("comp_b"))
            left = ends.filter("comp_a <> comp_b").select("shard", "group").distinct()
            again = settle(ends.join(left, ["shard", "group"], "left_semi").select("shard", F.explode(F.array("comp_a", "comp_b")).alias("comp")).distinct())
            if again.isEmpty():
                break
            forests *= 64
    release(blocks.sparkSession, stored)
    label = classes.join(comp.withColumnRenamed("node", "key"), "key", "left").select("class", "id", F.coalesce("component", "key").alias("comp"))
    least = label.groupBy("comp").agg(F.min("id").alias("component_id"))
    label = label.join(least, "comp").select("class", "comp", "component_id")
    return blocks, found.join(label, "class", "left").select("block", "at", "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "comp")
