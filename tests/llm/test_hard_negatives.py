"""Hard negatives against a search over all rows, Strassen against plain products."""

import math
import random

import duckdb
import numpy as np

from wayfare.llm.hard_negatives import ORACLE, Heaps, hard_negatives, scores, strassen
from wayfare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    last = lambda i: (i is None, i or 0)
    own = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, l) in enumerate(own):
        if i is None or i % every:
            continue
        found = [(clip(sum(x * y for x, y in zip(v, w))), j, m) for b, (j, w, m) in enumerate(own) if a != b]
        found.sort(key=lambda x: (-x[0], last(x[1])))
        for p, j, _ in [x for x in found if x[2] == l][:positives]:
            inside = [x for x in found if x[2] != l and 50 * p <= 100 * x[0] <= 95 * p][:negatives]
            out += [(i, j, r, k, p, n) for r, (n, k, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(x)[:6] for x in df.collect()), key=repr)


def test_strassen():
    r = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (33, 65, 40), (70, 64, 129), (100, 35, 33), (5, 0, 4), (0, 7, 3)):
        a, b = r.integers(-500, 500, (m, k)), r.integers(-500, 500, (k, n))
        assert (strassen(a, b) == a @ b).all() and (strassen(a, b, 8) == a @ b).all()
    a, b = r.integers(-(2**28), 2**28, (40, 70)), r.integers(-(2**28), 2**28, (50, 70))
    assert (scores(a, b) == a.astype(object) @ b.T.astype(object)).all()
    big = np.array([[2.0**80, 1.0]])
    assert scores(big, -big).tolist() == [[-(2**63)]] and scores(big, np.array([[0, 5]])).tolist() == [[5]]


def test_heaps_merge():
    r = random.Random(4)
    for _ in range(30):
        k, cols = r.randint(1, 5), r.randint(1, 40)
        s = np.array([[r.randint(-3, 3) for _ in range(cols)] for _ in range(6)])
        s[0, 0] = np.iinfo(np.int64).min
        ids, able = np.arange(cols), np.array([[r.random() < 0.6 for _ in range(cols)] for _ in range(6)])
        parts = [Heaps(6, k) for _ in range(2)]
        cut = r.randint(0, cols)
        for h, part in ((parts[0], slice(0, cut)), (parts[1], slice(cut, cols))):
            if ids[part].size:
                h.push(np.arange(6), s[:, part], ids[part], able[:, part])
        parts[0].merge(np.arange(6), parts[1].score, parts[1].id, parts[1].full)
        for i in range(6):
            want = sorted((-int(s[i, j]), j) for j in range(cols) if able[i, j])[:k]
            assert [(-int(x), int(y)) for x, y, f in zip(parts[0].score[i], parts[0].id[i], parts[0].full[i]) if f] == want


def test_against_brute_force(spark):
    """Ties, repeated rows and ids, nulls, odd widths, a label that holds most rows."""
    r = random.Random(8)
    vec = lambda n=7: [r.randint(-6, 6) / 8 + r.choice([0, 0.001]) for _ in range(n)]
    rows = [(i, vec(), 0 if r.random() < 0.6 else r.randint(1, 6)) for i in range(900)]
    rows += [(50, rows[50][1], rows[50][2]), (100, vec(), 3), (None, vec(), 2), (None, vec(), 0), (-50, vec(), 1), (1000, [], 0), (1001, vec(3), 0), (1050, vec(11), 2)]
    rows += [(1100, None, 1), (1150, vec(), None), (1200, [1.0, None], 1), (1250, [float("nan"), 0.0], 1), (1300, [float("inf")], 1)]
    for n, df in ((8, spark.createDataFrame(rows, SHAPE).repartition(7)), (1, spark.createDataFrame(rows, SHAPE).coalesce(1))):
        want = brute(rows)
        assert got(hard_negatives(df)) == want and len(want) > 100, n
    # chunks of anchors give the same rows, and so do columns that clash
    from pyspark.sql import functions as F

    many = spark.createDataFrame(rows, SHAPE).repartition(5).withColumns({c: F.lit(1) for c in ("id", "key", "score", "rank", "keys", "vector")})
    assert got(hard_negatives(many, chunk_bytes=400)) == brute(rows)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e200, 0.0], 1), (1, [1e200, 1.0], 1), (2, [5e150, 1.0], 2), (3, [1e-3, 0.0], 2), (4, [0.0, 1e300], 2), (5, [-1e200, 0.0], 1)]
    assert got(hard_negatives(spark.createDataFrame(rows, SHAPE))) == brute(rows)


def test_empty(spark):
    assert hard_negatives(spark.createDataFrame([], SHAPE)).collect() == []
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], SHAPE)).collect() == []
    assert hard_negatives(spark.createDataFrame([(7, [1.0], 1), (51, None, 2)], SHAPE)).collect() == []


def test_query(spark):
    df = QUERIES["op12_hard_negatives"](spark, SF)
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(ORACLE)
    assert [d[0] for d in want.description] == df.columns
    assert sorted(want.fetchall()) == sorted(tuple(x) for x in df.collect())
    assert got(df) == brute(rows) != []
