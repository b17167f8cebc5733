"""Conversation structure repair by Wagner-Fischer alignment to an alternating grammar.

A conversation's turns are aligned to the strings of `(s?(ua)+)?`: one role
initial a turn, an optional system turn, then user and assistant in turn. Keep
costs 0, Rerole to user or assistant 1, Delete 2, Insert 5; a truncated turn
that stays adds 5, a blank or repeated one must go. The strings of one kind
(`ua...`, `sua...`) are prefixes of each other, so one table of the alignment has
the cost of every feasible length in its last row. An incumbent, the cost of a
greedy repair, bounds the table to a band: a cell that is d deletions or inserts
off the diagonal costs at least as much (Ukkonen). Of equally cheap alignments
the audits (initials of the edits in order) are compared, and the least stays.

Long conversations are cut into segments of at most SEGMENT turns. A segment is
aligned from each state the grammar may be in (nothing yet, after s, after u,
after a) and gives the cheapest audit for each state it may end in; states and
costs of segments are then chained in order. That is exact: no cheapest repair
inserts, as deleting the turn beside an inserted one, and a system turn that is
left alone, costs two deletions at most, which is less than the insert; so audits
of a segment have its length, and the least of a concatenation is made of the
least of its parts.

Turns are sorted by conversation and turn over all tasks, so a conversation that
holds a third of all rows is shared by many. What lies inside one task is
finished there; only conversations that cross a border of tasks, or are very
large, go on as segments. Repeated turns are told by the first of each role and
text, an aggregate that combines before the shuffle.

Defined results: null roles and texts are one space; a null conversation id is a
conversation of its own, and so is each distinct id; turns with a null number
come first; of turns with one number the order is by role, then by a digest of
the text, so repeated rows are adjacent. A conversation without turns has zeros,
an empty audit and the digest of an empty string. An empty table gives no rows.
Columns other than the four named aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfare.llm.blocks import tidied
from wayfare.llm.line_dedup import SPACE
from wayfare.session import settle, ship

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Turns of a segment; bytes of text of one conversation that a task holds.
SEGMENT, HELD = 64, 16 << 20
#: States of the grammar: nothing yet, after s, after u, after a.
NONE, SYSTEM, USER, ASSISTANT = range(4)
EVERY, ACCEPTED = (NONE, SYSTEM, USER, ASSISTANT), (NONE, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

#: One turn as the alignment sees it: role initial, must go, truncated.
Turn = tuple[str, bool, bool]


def _symbol(pattern: str, j: int) -> str:
    """The j-th symbol of the endless string of a pattern: ua, au or sua."""
    if pattern == "sua":
        return "s" if j == 0 else "ua"[(j - 1) % 2]
    return pattern[j % 2]


def incumbent(turns: list[Turn], pattern: str) -> int:
    """Cost of a greedy repair: a turn that fits stays, one that doesn't is given the role or goes."""
    cost = j = 0
    for initial, gone, cut in turns:
        want = _symbol(pattern, j)
        if gone or cut or (initial != want and want == "s"):
            cost += DELETE
        else:
            cost += KEEP if initial == want else REROLE
            j += 1
    return cost


def align(turns: list[Turn], pattern: str, bound: int) -> dict[int, tuple[int, str]]:
    """For each length of the pattern's string that the turns reach at a cost of at most bound: (cost, least audit)."""
    above, below = bound // INSERT, bound // DELETE  # how far j may lead or lag
    row = {0: (0, "")}
    for j in range(1, above + 1):
        if _symbol(pattern, j - 1) == "s":
            break
        row[j] = (j * INSERT, "I" * j)
    for i, (initial, gone, cut) in enumerate(turns, 1):
        new: dict[int, tuple[int, str]] = {}
        for j in range(max(0, i - below), i + above + 1):
            best = None
            if (up := row.get(j)) is not None:
                best = (up[0] + DELETE, up[1] + "D")
            if j:
                want = _symbol(pattern, j - 1)
                if not gone and (before := row.get(j - 1)) is not None and (initial == want or want in ROLE):
                    other = (before[0] + (KEEP if initial == want else REROLE) + CUT * cut, before[1] + ("K" if initial == want else "R"))
                    best = other if best is None else min(best, other)
                if want in ROLE and (left := new.get(j - 1)) is not None:
                    other = (left[0] + INSERT, left[1] + "I")
                    best = other if best is None else min(best, other)
            if best is not None and best[0] <= bound:
                new[j] = best
        row = new
    return row


def _end(start: int, pattern: str, j: int) -> int:
    """State after j symbols of the pattern."""
    if j == 0:
        return start
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[_symbol(pattern, j - 1)]


#: By how much a state's cheapest rest may differ from another's: a user and an assistant turn inserted.
SLACK = 2 * INSERT


def segment_table(turns: list[Turn], starts: tuple[int, ...] = EVERY, ends: tuple[int, ...] = EVERY) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after): the cheapest (cost, least audit) of a segment, without those that can't be part of a cheapest repair."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    slack = 0 if starts == (NONE,) and ends == ACCEPTED else SLACK  # a whole conversation needs its best only
    for pattern, froms in (("ua", (NONE, SYSTEM, ASSISTANT)), ("au", (USER,)), ("sua", (NONE,))):
        froms = tuple(p for p in froms if p in starts)
        if not froms:
            continue
        bound = incumbent(turns, pattern)
        while True:
            found: dict[tuple[int, int], tuple[int, str]] = {}
            for j, x in align(turns, pattern, bound).items():
                for p in froms:
                    key = (p, _end(p, pattern, j))
                    if key[1] in ends:
                        found[key] = min(found.get(key, x), x)
            # what costs no more than the bound is exact; each state needs its best and what lies within the slack
            least = [min((x[0] for (a, _), x in found.items() if a == p), default=None) for p in froms]
            if None in least:
                bound += SLACK
            elif max(least) + slack > bound:
                bound = max(least) + slack
            else:
                break
        for key, x in found.items():
            out[key] = min(out.get(key, x), x)
    return out


class Chain:
    """Segments of one conversation in order: cheapest way into each state, ties by the least audit."""

    def __init__(self):
        # cost and rank of the audit so far; audits of one state of progress have one length, so ranks stand for them
        self.at = {NONE: (0, 0)}
        self.back: list[dict[int, int]] = []

    def add(self, table: dict[tuple[int, int], tuple[int, str]]) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for (p, q), (cost, audit) in table.items():
            if p in self.at:
                x = (self.at[p][0] + cost, self.at[p][1], audit, p)
                if q not in best or x < best[q]:
                    best[q] = x
        order = {x: r for r, x in enumerate(sorted({(x[1], x[2]) for x in best.values()}))}
        self.at = {q: (x[0], order[x[1], x[2]]) for q, x in best.items()}
        self.back.append({q: x[3] for q, x in best.items()})

    def finish(self) -> tuple[int, list[tuple[int, int]]]:
        """(cost, the states before and after each segment) of the cheapest repair."""
        q = min((s for s in ACCEPTED if s in self.at), key=lambda s: self.at[s])
        cost, out = self.at[q][0], []
        for back in reversed(self.back):
            out.append((back[q], q))
            q = back[q]
        return cost, out[::-1]


class Sums:
    """What is counted over a conversation's turns in order."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "low", "high")

    def __init__(self, **have):
        for name in self.NAMES:
            setattr(self, name, have.get(name, None if name in ("first", "last", "low", "high") else 0))

    def add(self, other: Sums) -> None:
        """Counts of the turns behind these."""
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        if self.high is not None and self.high == other.low:
            self.distinct -= 1
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def row(self) -> dict:
        return {name: getattr(self, name) for name in self.NAMES}


def one_turn(turn: int | None, initial: str, fault: str) -> Sums:
    return Sums(first=initial, last=initial, low=turn, high=turn, distinct=int(turn is not None), **({fault: 1} if fault else {}))


class Segment:
    """Some turns of one conversation, one behind the other."""

    def __init__(self):
        self.sums = Sums()
        self.turns: list[Turn] = []
        self.roles: list[str] = []
        self.texts: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.sums.add(one_turn(turn, role[:1], fault))
        self.turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> Iterator[str]:
    """The turns that an audit leaves, as role:text; state: that of the grammar before them."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role = "assistant" if state == USER else "user"
        if edit == "K":
            role = roles[i]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        else:
            state = USER if role == "user" else ASSISTANT
        yield f"{role}:{'' if edit == 'I' else texts[i]}"
        i += edit != "I"


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, repaired_sha256 string"
SEGMENTS = "seg long, sums struct<blank:long, duplicate:long, truncated:long, illegal:long, distinct:long, first:string, last:string, low:long, high:long>, table array<struct<p:int, q:int, cost:long, audit:string>>, roles array<string>, texts array<string>"
_SUMS = pa.struct([(n, pa.string() if n in ("first", "last") else pa.int64()) for n in Sums.NAMES])
_TABLE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_DONE = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in RESULT.split(", ")])
_OPEN = pa.struct([("seg", pa.int64()), ("sums", _SUMS), ("table", _TABLE), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


class Output:
    """Batches of (conversation, done, open), of which one is null."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.bytes = kind, [], 0

    def add(self, key, done: dict | None, part: dict | None, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append((key, done, part))
        self.bytes += size
        if len(self.rows) >= 2000 or self.bytes > 8 << 20:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            keys, done, part = zip(*self.rows)
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, self.kind), pa.array(done, _DONE), pa.array(part, _OPEN)], names=["conv", "done", "open"])


def _result(sums: Sums, cost: int, audit: str, text: str | None, digest: str) -> dict:
    return {"gaps": sums.gaps(), "blank": sums.blank, "duplicate": sums.duplicate, "truncated": sums.truncated, "illegal": sums.illegal, "cost": cost, "audit": audit, "repaired": text, "repaired_sha256": digest}


def finish(segments: list[Segment], with_text: bool) -> dict:
    """A whole conversation."""
    sums, chain, tables = Sums(), Chain(), []
    for i, s in enumerate(segments):
        sums.add(s.sums)
        tables.append(segment_table(s.turns, EVERY if i else (NONE,), EVERY if i < len(segments) - 1 else ACCEPTED))
        chain.add(tables[-1])
    cost, states = chain.finish()
    audits = [t[x][1] for t, x in zip(tables, states)]
    text = "\n".join(x for s, a, (p, _) in zip(segments, audits, states) for x in repaired(s.roles, s.texts, a, p))
    return _result(sums, cost, "".join(audits), text if with_text else None, hashlib.sha256(text.encode()).hexdigest())


def _aligner(kind: pa.DataType, with_text: bool):
    """Over turns in order: whole conversations of a task are finished, those at its borders leave segments."""

    def run(batches):
        out, number = Output(kind), TaskContext.get().partitionId() << 32
        key: object = None
        segments: list[Segment] = []
        held, border, begun = 0, True, False

        def leave():
            """What is held of a conversation goes on as segments; seg tells their order over all tasks."""
            nonlocal number, segments, held
            for s in segments or [Segment()]:
                table = segment_table(s.turns)
                part = {"seg": number, "sums": s.sums.row(), "table": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in table.items()], "roles": s.roles, "texts": s.texts}
                number += 1
                yield from out.add(key, None, part, sum(map(len, s.texts)))
            segments, held = [], 0

        def close(last: bool):
            if border or last:
                yield from leave()
            else:
                yield from out.add(key, finish(segments, with_text), None, held)

        for batch in batches:
            for k, turn, role, text, alive, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key or (k is None) != (key is None):
                    if begun:
                        yield from close(False)
                        border = False
                    key, segments, held, begun = k, [], 0, True
                if not alive:
                    continue
                if not segments or len(segments[-1].turns) >= SEGMENT:
                    if held > HELD:
                        border = True
                        yield from leave()
                    segments.append(Segment())
                segments[-1].add(turn, role, text, fault)
                held += len(role) + len(text) + 64
        if begun:
            yield from close(True)
        yield from out.flush()

    return run


def _chainer(kind: pa.DataType):
    """Over segments without texts, by conversation and in order: the states before and after each, and the sums."""

    def run(batches):
        key: object = None
        begun, chain, sums, segs = False, Chain(), Sums(), []

        def close():
            cost, states = chain.finish()
            n = len(segs)
            result = [_result(sums, cost, "", None, "")] + [None] * (n - 1)
            for a in range(0, n, 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(segs[part]), kind), pa.array(segs[part], pa.int64()), pa.array([p for p, _ in states[part]], pa.int32()), pa.array([q for _, q in states[part]], pa.int32()), pa.array(result[part], _DONE)], names=["conv", "seg", "p", "q", "sums"])

        for batch in batches:
            for k, seg, own, table in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key or (k is None) != (key is None):
                    if begun:
                        yield from close()
                    key, begun, chain, sums, segs = k, True, Chain(), Sums(), []
                sums.add(Sums(**own))
                chain.add({(x["p"], x["q"]): (x["cost"], x["audit"]) for x in table})
                segs.append(seg)
        if begun:
            yield from close()

    return run


def _joiner(kind: pa.DataType, with_text: bool):
    """Over repaired segments, by conversation and in order: one row a conversation."""

    def run(batches):
        out = Output(kind)
        key: object = None
        begun, sums, audits, texts, digest, empty = False, None, [], [], hashlib.sha256(), True

        def close():
            yield from out.add(key, sums | {"audit": "".join(audits), "repaired": "\n".join(texts) if with_text else None, "repaired_sha256": digest.hexdigest()}, None, sum(map(len, texts)))

        for batch in batches:
            for k, own, audit, text, none in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key or (k is None) != (key is None):
                    if begun:
                        yield from close()
                    key, begun, sums, audits, texts, digest, empty = k, True, own, [], [], hashlib.sha256(), True
                audits.append(audit)
                if not none:
                    digest.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
                    if with_text:
                        texts.append(text)
        if begun:
            yield from close()
        yield from out.flush()

    return run


def _pieces(kind: pa.DataType):
    """Segments with their states: what stays of their turns."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, seg, p, sums, audit, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                kept = list(repaired(roles, texts, audit, p))
                rows.append((k, seg, sums, audit, "\n".join(kept), not kept))
            keys, segs, sums, audits, texts, none = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(segs, pa.int64()), pa.array(sums, _DONE), pa.array(audits, pa.string()), pa.array(texts, pa.string()), pa.array(none, pa.bool_())], names=["conv", "seg", "sums", "audit", "text", "none"])

    return run


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text, alive) settled with fault: blank, duplicate, truncated or empty; and what orders them."""
    bare = F.btrim("text", F.lit(SPACE))
    own = settle(turns.withColumn("digest", F.when(F.col("alive"), F.md5("text"))).withColumn("u", F.monotonically_increasing_id()))
    first = own.filter("alive").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "u")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = settle(first.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), "first.u"))
    again = F.col("u_").isNotNull() & (F.col("u_") != F.col("u"))
    joined = own.join(first.withColumnRenamed("u", "u_"), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")), "left")
    fault = F.when(bare == "", "blank").when(again, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return joined.select("conv", "turn", "role", "text", "alive", fault.alias("fault"), "digest", "u")


def repair(turns: DataFrame, with_text: bool = True) -> DataFrame:
    """turns (conv, turn, role, text, alive) to a row a conversation: conv, counts, cost, audit, repaired (null unless with_text), repaired_sha256.

    Rows that aren't alive only name their conversation.
    """
    spark = turns.sparkSession
    ship(spark)
    kind = to_arrow_type(turns.schema["conv"].dataType)
    of = dict(turns.dtypes)["conv"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "u")]
    ranged = faults(turns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    both = settle(ranged.select("conv", "turn", "role", "text", "alive", "fault").mapInArrow(tidied(_aligner(kind, with_text)), f"conv {of}, done struct<{_fields(RESULT)}>, open struct<{_fields(SEGMENTS)}>"))
    done = both.filter("done IS NOT NULL").select("conv", "done.*")
    opened = both.filter("open IS NOT NULL").select("conv", "open.*")
    together = lambda df: df.repartition("conv").sortWithinPartitions("conv", "seg")
    states = settle(together(opened.select("conv", "seg", "sums", "table")).mapInArrow(tidied(_chainer(kind)), f"conv {of}, seg long, p int, q int, sums struct<{_fields(RESULT)}>"))
    picked = opened.select("seg", "table", "roles", "texts").join(states, "seg")
    audit = F.filter("table", lambda x: (x["p"] == F.col("p")) & (x["q"] == F.col("q")))[0]["audit"]
    pieces = picked.select("conv", "seg", "p", "sums", audit.alias("audit"), "roles", "texts").mapInArrow(tidied(_pieces(kind)), f"conv {of}, seg long, sums struct<{_fields(RESULT)}>, audit string, text string, none boolean")
    late = together(pieces).select("conv", "sums", "audit", "text", "none").mapInArrow(tidied(_joiner(kind, with_text)), f"conv {of}, done struct<{_fields(RESULT)}>, open struct<{_fields(SEGMENTS)}>")
    return done.unionByName(late.select("conv", "done.*"))


def _fields(columns: str) -> str:
    """name type, ... as the fields of a struct."""
    out, depth = [], 0
    for x in columns.split(", "):
        if depth == 0:
            name, _, rest = x.partition(" ")
            x = f"{name}: {rest}"
        out.append(x)
        depth += x.count("<") - x.count(">")
    return ", ".join(out)


def plain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of conversations as repair() takes it."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"), F.lit(True).alias("alive"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of plain() with faults planted by crc32 of conv:turn modulo 20; dropped rows stay as rows that aren't alive."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn"))) % 20
    rows = rows.withColumn("kind", kind).withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("alive"),
    )


def conversation_repair(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The damaged table's repair: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    out = repair(damaged(plain(conversations, id_col)), with_text=False)
    return out.select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
