"""Substring and suffix-array dedup against plain recomputation."""

import hashlib
import random

import numpy as np

from wayfare.llm.substring_dedup import automaton_kernel, substring_dedup
from wayfare.llm.suffix_array import difference_cover_sort, search, suffix_array_dedup, suffix_kernel


def brute(docs, length, split):
    first = {}
    for d, t in docs:
        u = split(t)
        for i in range(len(u) - length + 1):
            w = u[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in docs:
        u = split(t)
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - length + 1):
            if first[u[i : i + length]] < d:
                gone[i : i + length] = True
        out.append((d, u, gone))
    return out


def sample():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["é", "ß x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [text(30) for _ in range(3)]
    docs = []
    for i in range(120):
        kind = i % 6
        t = text(r.randint(0, 80))
        if kind == 1:
            t = text(9) + "\n" + shared[i % 3] + "\t" + text(7)
        if kind == 2:
            t = shared[1] + "  " + shared[2]
        if kind == 3 and docs:
            t = docs[r.randrange(len(docs))][1] or ""
        if kind == 4:
            t = "a b c " * r.randint(0, 40)
        docs.append((i * 3 % 121, t))
    docs += [(500, None), (501, ""), (502, "  "), (503, shared[0]), (503, shared[0]), (700, text(5000))]
    return docs


def test_difference_cover_sort():
    r = np.random.default_rng(3)
    for n in [*range(1, 40), 500, 501, 502]:
        s = r.integers(1, 4, n)
        got = difference_cover_sort(s)
        assert got.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_difference_cover_sort_of_wide_values():
    """Triples that don't fit into 64 bits are named in two steps, also on the second level."""
    r = np.random.default_rng(4)
    for n in (30, 31, 32):
        s = np.tile(r.integers(1, 2**31, 5), 8)[:n]
        assert difference_cover_sort(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_kernels_agree():
    r = random.Random(1)
    ctx = [" ".join(r.choice("ab") for _ in range(r.randint(6, 40))).encode() for _ in range(60)]
    ctx = list(dict.fromkeys(ctx))
    low = [r.randrange(1000) for _ in ctx]
    for split, kernel in ((lambda c: tuple(c.split(b" ")), automaton_kernel), (lambda c: c, suffix_kernel)):
        first = {}
        for c, d in zip(ctx, low):
            u = split(c)
            for i in range(len(u) - 5):
                first[u[i : i + 6]] = min(d, first.get(u[i : i + 6], d))
        want = [first[split(c)[i : i + 6]] for c in ctx for i in range(len(split(c)) - 5)]
        assert kernel(ctx, low, 6).tolist() == want


def test_substring_dedup(spark):
    docs = sample()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int").repartition(5)
    got = sorted(tuple(r) for r in substring_dedup(df).collect())
    want = sorted((d, len(u), int(g.sum()), hashlib.sha256(b" ".join(w for w, x in zip(u, g) if not x)).hexdigest()) for d, u, g in brute(docs, 13, lambda t: tuple((t or "").encode().split())))
    assert got == want
    assert sum(x[2] for x in got) > 500


def test_suffix_array_dedup(spark):
    docs = sample()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in suffix_array_dedup(df).collect())
    want = []
    for d, u, g in brute(docs, 50, lambda t: (t or "").encode()):
        want.append((d, len(u), int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0, hashlib.sha256(bytes(np.frombuffer(u, np.uint8)[~g])).hexdigest()))
    assert got == sorted(want)


def test_last_stage_gets_places_only(spark):
    """Shards answer with the places that earlier texts cover; keys and whole windows aren't worked out again for that."""
    shared = "".join(f"{i:03d}" for i in range(40))
    found = search(50)
    noted = found.start(spark.createDataFrame([(1, "x" + shared), (2, shared + "y"), (3, None)], "doc_id long, text string").repartition(1), "doc_id", "text")
    assert not {"n1", "n2"} & set(noted.columns)
    gone = {}
    for row in noted.collect():
        row = row.asDict(recursive=True)
        units, own = found.covered(row)
        gone |= {int(i): own[x:y].sum() for i, x, y in zip(units.block.ids, units.bounds[:-1], units.bounds[1:])}
    assert gone == {1: 0, 2: 120, 3: 0}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).count() == 0 and suffix_array_dedup(df).count() == 0
