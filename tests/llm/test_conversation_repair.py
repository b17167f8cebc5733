"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from wayfare.llm import conversation_repair as R
from wayfare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, least audit) over all edits, inserts included, from the front to the end of the turns."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(turns) and state in ("", "a") else []
        if i < len(turns):
            initial, gone, cut = turns[i]
            c, a = best(i + 1, state, 0)
            found.append((2 + c, "D" + a))
            for t, to in step[state].items():
                if not gone and (initial == t or t in "ua"):
                    c, a = best(i + 1, to, 0)
                    found.append(((initial != t) + 5 * cut + c, ("K" if initial == t else "R") + a))
        if inserted < 3:
            for t, to in step[state].items():
                if t in "ua":
                    c, a = best(i, to, inserted + 1)
                    found.append((5 + c, "I" + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def brute(rows, damage=True):
    word = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = word(role), word(text)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20 if damage else -1
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(tuple(turns))
        assert "I" not in audit  # what the chaining of segments rests on
        text = "\n".join(R.repaired([r for _, r, _ in own], [t for _, _, t in own], audit, R.NONE))
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def some_turns(r, n):
    return [(r.choice("ssuuuuaaaax "), r.random() < 0.15, r.random() < 0.2) for _ in range(n)]


def test_alignment_of_whole_conversations():
    r = random.Random(1)
    for _ in range(1500):
        turns = some_turns(r, r.randint(0, 9))
        chain = R.Chain()
        chain.add(R.segment_table(turns, (R.NONE,), R.ACCEPTED))
        cost, states = chain.finish()
        assert (cost, R.segment_table(turns, (R.NONE,), R.ACCEPTED)[states[0]][1]) == cheapest(tuple(turns)), turns


def test_segments_chain_to_the_whole():
    r = random.Random(2)
    for _ in range(700):
        turns = some_turns(r, r.randint(0, 14))
        chain, tables, i = R.Chain(), [], 0
        while i < len(turns) or not tables:
            n = r.randint(0, 4)
            tables.append(R.segment_table(turns[i : i + n]))
            chain.add(tables[-1])
            i += n
        cost, states = chain.finish()
        assert (cost, "".join(t[s][1] for t, s in zip(tables, states))) == cheapest(tuple(turns)), turns


def test_band_leaves_nothing_out():
    r = random.Random(3)
    for _ in range(200):
        turns = some_turns(r, r.randint(0, 12))
        for pattern in ("ua", "au", "sua"):
            whole = R.align(turns, pattern, 7 * len(turns) + 20)
            for bound in (0, 3, 9, 20):
                assert R.align(turns, pattern, bound) == {j: x for j, x in whole.items() if x[0] <= bound}


def conversations(r, n):
    text = lambda: r.choice(["Yes.", "No!", "Why?", "cut off", "ends with space. ", "tab.\t", "", " \x0b", "Grüße.", "a" * 40]) if r.random() < 0.4 else f"text {r.randrange(10**6)}{r.choice(['.', '!', '', '?'])}"
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 9)):
            rows.append((c, r.choice([t, t, t, t + 3, None]), ["user", "assistant"][t % 2] if r.random() < 0.8 else r.choice(["system", "user", "tool", "", None, "assistant"]), text() if r.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("segment,held", [(64, 16 << 20), (3, 16 << 20), (2, 100)])
def test_query_against_brute_force(spark, monkeypatch, segment, held):
    r = random.Random(segment)
    rows = conversations(r, 120)
    rows += rows[:30]  # repeated rows
    rows += [(None, t, "user" if t % 2 else "assistant", f"of nobody {t % 5}.") for t in range(12)] + [(None, None, None, None)]
    rows += [(5000, t, ["user", "assistant"][t % 2], f"one large conversation {t if t % 7 else 7}{'.' if t % 5 else ''}") for t in range(400)]
    rows += [(5001, 3, "user", "same turn, same text.")] * 150 + [(5002, None, "assistant", f"no number {i}.") for i in range(90)] + [(6000, 1, "user", "x" * 300_000 + "."), (6000, 2, "assistant", "ok.")]
    monkeypatch.setattr(R, "SEGMENT", segment)
    monkeypatch.setattr(R, "HELD", held)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert rows_of(R.conversation_repair(df)) == brute(rows)


def test_one_conversation_is_shared_by_tasks(spark):
    """All rows are of one conversation: each task aligns a part."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"text {t}.") for t in range(3000)]
    turns = R.plain(spark.createDataFrame(rows, SHAPE))
    sizes = [x.n for x in turns.repartitionByRange(8, "conv", "turn").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1000
    got = R.repair(turns).collect()
    assert len(got) == 1 and got[0].cost == 0 and got[0].audit == "K" * 3000 and got[0].repaired == "\n".join(f"{r}:{x}" for _, _, r, x in rows)


def test_columns_and_empty_tables(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 1, "system", "S."), (None, 1, "assistant", "x.")]
    df = spark.createDataFrame(rows, "conv string, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("kind", "copy", "seg", "u", "fault", "alive", "done")})
    got = {x.conv: x for x in R.repair(R.plain(df, "conv")).collect()}
    assert {k: (x.cost, x.audit, x.repaired) for k, x in got.items()} == {"a": (0, "KK", "user:Hi.\nassistant:Yes."), "b": (2, "D", ""), None: (2, "D", "")}
    assert R.conversation_repair(spark.createDataFrame([], SHAPE)).collect() == []


def test_query(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_conversation_repair"](spark, SF)) == brute(rows)
