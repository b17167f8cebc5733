"""N-gram Jaccard join against all pairs compared one by one."""

import random
from collections import Counter

from wayfare.llm.jaccard_join import divide_skip, jaccard_components, one_of_each_component


def brute(docs, width=5):
    lower = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = []
    for _, t in docs:
        w = (t or "").translate(lower).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y, key=lambda k: docs[k][0])] = min(x, y, key=lambda k: docs[k][0])
    return sorted((d, len(s), docs[find(i)][0]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def test_divide_skip():
    r = random.Random(2)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randint(1, 25))) for _ in range(r.randint(1, 12))]
        need = r.randint(1, 12)
        want = {x: n for x in range(30) if (n := sum(x in own for own in lists)) >= need}
        assert divide_skip(lists, need) == want


def test_components(spark):
    r = random.Random(9)
    text = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    docs, n = [], 0
    for g in range(25):
        base = text(r.choice([3, 5, 8, 40, 120]))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"x{r.randrange(50)}"
            docs.append((n * 7 % 1009, " ".join(w).upper() if n % 5 == 0 else "\t".join(w)))
            n += 1
    chain = text(60)
    for k in range(12):
        chain = chain[4:] + text(4)
        docs.append((2000 - k, " ".join(chain)))
    shared = text(40)
    docs += [(3000 + k, " ".join(shared + text(k))) for k in range(20)]
    docs += [(4000, None), (4001, ""), (4002, "one"), (4003, "One"), (4004, "two words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", __import__("pyspark").sql.functions.lit(1)).repartition(6)
    got = sorted(tuple(x) for x in jaccard_components(df).collect())
    assert got == brute(docs)
    assert len({c for _, _, c in got}) < len(got) - 60


def test_links_across_components(spark, monkeypatch):
    """Without any hub links, the search by segments alone finds every link."""
    from wayfare.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "_bands", lambda items: [int(items[0]) >> 1])
    r = random.Random(31)
    docs = []
    for g in range(12):
        base = [f"g{g}w{r.randrange(500)}" for _ in range(r.choice([6, 30, 150]))]
        for k in range(5):
            w = list(base)
            for _ in range(k % 3 + 1):
                w[r.randrange(len(w))] = f"x{r.randrange(900)}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in jaccard_components(df).collect()) == brute(docs)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows of one id, or of none, stay apart unless their texts link."""
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    docs = []
    for g in range(12):
        base = text(40)
        near = [*base[:-1], "end"]
        alone = text(30)
        docs += [(None, base), (None, near), (None, alone), (g % 3, text(25)), (50 + g, text(6))]
        if g % 2:
            docs += [(100 + g, base), (100 + g, text(20)), (200 - g, near)]
    docs = [(d, " ".join(w)) for d, w in docs] + [(None, None), (None, ""), (1, "  "), (1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    big = 10**6
    want = brute([(big if d is None else d, t) for d, t in docs])
    got = sorted((big if d is None else d, n, big if c is None else c) for d, n, c in jaccard_components(df).collect())
    assert got == want
    kept = [tuple(x) for x in one_of_each_component(df).collect()]
    assert set(kept) <= set(docs)
    # of each group base and near link, so one of all its linked rows stays: that of the least id
    linked = [(d, t) for d, t in docs if t and len(t.split()) == 40]
    assert Counter(x for x in kept if x not in linked) == Counter(x for x in docs if x not in linked)
    assert Counter(d for d, t in kept if (d, t) in linked) == Counter([None] * 6 + [100 + g for g in range(1, 12, 2)])


def listed_pairs(monkeypatch):
    """What each call of the segment search lists."""
    from wayfare.llm import jaccard_join

    counts, search = [], jaccard_join._segment_pairs

    def counted(*a):
        out = search(*a).cache()
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_segment_pairs", counted)
    return counts


def changed(r, words, share, names):
    return [f"{names}{r.randrange(10**6)}" if r.random() < share else w for w in words]


def test_two_large_groups_of_long_texts(spark, monkeypatch):
    """About 0.7 alike between the groups and over 0.9 inside: no pair between the groups needs a check on whole sets, or few do."""
    counts = listed_pairs(monkeypatch)
    totals = []
    for n in (15, 45):
        r = random.Random(n)
        one = [f"w{r.randrange(10**6)}" for _ in range(2600)]
        two = changed(r, one, 0.035, "y")
        docs = [(2 * i + g, " ".join(changed(r, base, 0.004, "z"))) for g, base in enumerate((one, two)) for i in range(n)]
        del counts[:]
        got = sorted(tuple(x) for x in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())
        assert [x[2] for x in got] == [x[0] % 2 for x in got]
        totals.append(sum(counts))
    assert totals[1] <= 3 * totals[0] + 2 * 90


def test_star_of_copies(spark, monkeypatch):
    """Copies link with their origin only; with no hub links at all, the search by segments lists them in proportion to the documents."""
    from wayfare.llm import jaccard_join

    counts = listed_pairs(monkeypatch)
    monkeypatch.setattr(jaccard_join, "_bands", lambda items: [int(items[0]) >> 1])
    for n in (40, 160):
        r = random.Random(n)
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        docs = [(5000, " ".join(base))] + [(i, " ".join(changed(r, base, 0.022, "z"))) for i in range(n)]
        del counts[:]
        assert sorted(tuple(x) for x in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()) == brute(docs)
        assert sum(counts) < 60 * n


def test_bitmaps_never_rule_out_a_link():
    """Of two linked sets some segment passes by itself and with its chain; bits that differ never outnumber items."""
    import numpy as np

    from wayfare.llm.jaccard_join import chain_sizes, divisions, linked, parities
    from wayfare.llm.repeats import U, mix

    r = np.random.default_rng(5)
    for n in (20, 300, 700, 3000):
        for _ in range(20):
            x = np.unique(r.integers(0, 2**63, n).astype(U))
            keep = r.random(len(x)) >= 0.1
            y = np.unique(np.concatenate([x[keep], r.integers(0, 2**63, int(len(x) * r.uniform(0, 0.1))).astype(U)]))
            shared = len(np.intersect1d(x, y))
            if not linked(len(x), len(y), shared, 80, 100):
                continue
            passed = 0
            for count in divisions(len(x), 80, 100) & divisions(len(y), 80, 100):
                at = [(mix(s) % U(count)).astype(np.int64) for s in (x, y)]
                bits = [parities(s, a, count) for s, a in zip((x, y), at)]
                own = [np.bincount(a, minlength=count) for a in at]
                both = sum(chain_sizes(s) for s in own)
                apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1)
                for k in range(count):
                    m = len(np.intersect1d(x[at[0] == k], y[at[1] == k]))
                    passed += linked(own[0][k], own[1][k], m, 80, 100) and apart[k] * 180 <= both[k] * 20
            assert passed


def test_forests_keep_components():
    import numpy as np

    from wayfare.llm.jaccard_join import Forests

    r = random.Random(6)
    for k in (1, 3):
        comps = np.array([r.randrange(30) for _ in range(80)])
        edges = [(i, j) for i in range(80) for j in range(i) if comps[i] != comps[j] and r.random() < 0.1]
        found = Forests(comps, k, batch=50)
        for i, j in edges:
            x = np.array([j])
            w = np.array([r.random()])
            new = found.open(i, x, w)
            found.add(x[new], x[new] * 0 + i, found.of[x[new]], x[new] * 0 + found.of[i], w[new])
        found.settle()

        def groups(pairs):
            up = list(range(30))
            for a, b in pairs:
                x, y = (next(iter([c])) for c in (a, b))
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
            out = []
            for x in range(30):
                while up[x] != x:
                    x = up[x]
                out.append(x)
            return out

        kept = [(int(comps[a]), int(comps[b])) for a, b in found.edges[:2].T]
        assert groups(kept) == groups([(int(comps[i]), int(comps[j])) for i, j in edges])
        assert len(kept) <= k * 29 and (found.suppressed or len(kept) == len(edges))


def test_sets_are_moved_once(spark, monkeypatch):
    """Joins by id read the sets where they lie; a routed segment carries 64 bytes of bitmap and 4 for an item."""
    from pyspark.sql import functions as F

    from wayfare.llm import jaccard_join

    plans, sizes = [], []
    hubs, search = jaccard_join._hub_links, jaccard_join._segment_pairs

    def seen_hubs(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return hubs(rows, *rest)

    def seen_search(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        sizes.append(rows.agg(F.max(F.length("parity")), F.max(F.length("items") / F.col("size"))).first())
        return search(rows, *rest)

    monkeypatch.setattr(jaccard_join, "_hub_links", seen_hubs)
    monkeypatch.setattr(jaccard_join, "_segment_pairs", seen_search)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    docs = [(i, " ".join(changed(r, base, 0.03, "z"))) for i in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the hubs' side is dealt, the sets aren't
    assert plans[0].count("Exchange hashpartitioning(id") == 1 and "Exchange" not in plans[1]
    assert sizes and sizes[0][0] == 64 and sizes[0][1] <= 4


def test_later_rounds_leave_sets_in_place(spark, monkeypatch):
    """Rows that go again are joined by id to the shards they go to: no exchange holds their sets."""
    from wayfare.llm import blocks, jaccard_join

    rows = [(i, i, b"s" * 400, i) for i in (1, 2, 3, 4, 5, 9)]
    rest = blocks.by_key(spark.createDataFrame(rows, "id long, comp long, items binary, m long"), "id", "rest_of_later_rounds")
    try:
        # 2 and 3 are of component 1, 5 of 4, 9 is alone
        comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "node long, component long")
        again = spark.createDataFrame([(7, 1), (8, 1), (8, 9)], "shard int, comp long")
        monkeypatch.setattr(jaccard_join, "NAMED", 1)
        assert sorted((r["id"], r["comp"], r["to"]) for r in jaccard_join._rows_again(rest, comp, again).collect()) == [(1, 1, None), (2, 1, None), (3, 1, None), (9, 9, [8])]
        monkeypatch.undo()
        out = jaccard_join._rows_again(rest, comp, again)
        assert sorted((r["id"], sorted(r["to"])) for r in out.collect()) == [(1, [7, 8]), (2, [7, 8]), (3, [7, 8]), (9, [8])]
        kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = jaccard_join._rows_again(rest, comp, again)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        lines = found.splitlines()
        # below the scan of the sets no exchange stands between it and its join
        at = next(i for i, x in enumerate(lines) if "FileScan" in x)
        depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
        above, d = [], depth[at]
        for i in range(at - 1, -1, -1):
            if depth[i] < d:
                above.append(lines[i])
                d = depth[i]
        assert not any("Exchange" in x for x in above), found
    finally:
        blocks.release(spark, ["rest_of_later_rounds"])
