"""Paths, noding and polygons against plain searches, on random data in any direction."""

import heapq
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from wayfare.operators.noding import node_lines
from wayfare.operators.overlay import cut_into_cells, overlay_paths
from wayfare.operators.polygons import hull, in_ring, line_share, ring_share

EDGE = "u long, v long, cost long, ux long, uy long, vx long, vy long"
ASK = "request_id long, source long, target long, sx long, sy long, tx long, ty long"


def test_overlay_paths(spark):
    """Clustered nodes, one-way edges, edges of no cost, requests without a path and from a node to itself; cells from tiny to one."""
    r = random.Random(5)
    at = [(r.randrange(40_000), r.randrange(40_000)) if i % 3 else (20_000 + r.randrange(900), 20_000 + r.randrange(900)) for i in range(150)]
    far = lambda a, b: math.dist(at[a], at[b])
    edges = {}
    for a in range(150):
        for b in sorted(range(150), key=lambda b: far(a, b))[1:6]:
            edges[a, b] = r.choice([0, int(far(a, b)) + r.randrange(300)])
            if r.random() < 0.6:
                edges[b, a] = int(far(a, b)) + r.randrange(300)
    rows = [(a, b, c, *at[a], *at[b]) for (a, b), c in edges.items()]
    asked = [(i, s, t, *at[s], *at[t]) for i, (s, t) in enumerate([(r.randrange(150), r.randrange(150)) for _ in range(14)] + [(3, 3), (5, 5)])]

    def brute(s, t):
        held = lambda n: far(s, n) + far(n, t) <= far(s, t) * 1.5
        best, queue = {s: 0}, [(0, s)]
        out = {}
        for (a, b), c in edges.items():
            if held(a) and held(b):
                out.setdefault(a, []).append((b, c))
        while queue:
            c, x = heapq.heappop(queue)
            if c > best[x]:
                continue
            for y, d in out.get(x, ()):
                if c + d < best.get(y, 1 << 60):
                    best[y] = c + d
                    heapq.heappush(queue, (c + d, y))
        return best.get(t)

    want = {i: brute(s, t) for i, s, t, *_ in asked}
    assert None in want.values() and len([x for x in want.values() if x]) > 4
    e, q = spark.createDataFrame(rows, EDGE), spark.createDataFrame(asked, ASK)
    for most in (30, 4000):
        got = overlay_paths(q, e, max_edges=most, grid=9000).collect()
        assert {x.request_id: x.total for x in got} == want
        for i, s, t, *_ in asked:
            path = [(x.u, x.v) for x in sorted((x for x in got if x.request_id == i and x.seq is not None), key=lambda x: x.seq)]
            if want[i] is None or s == t:
                assert not path
                continue
            assert path[0][0] == s and path[-1][1] == t and all(a[1] == b[0] for a, b in zip(path, path[1:])) and sum(edges[x] for x in path) == want[i]
    sizes = cut_into_cells(e, 40).groupBy("ucell").count().collect()
    assert max(x["count"] for x in sizes) <= 40 and len(sizes) > 10
    loose = {x.request_id: x.total for x in overlay_paths(q, e, slack=0.5, expand=False).collect()}
    assert all((loose[i] is None) == (w is None) and (not w or w <= loose[i] <= 1.5 * w) for i, w in want.items())
    assert overlay_paths(q.limit(0), e).count() == 0 and {x.total for x in overlay_paths(q, e.limit(0), expand=False).collect()} == {None, 0}


def test_noding(spark):
    """Crossings, touches at ends and inside, overlaps, lines that only share an end, and lines far apart."""
    lines = [(1, 0, 0, 100, 100), (2, 0, 100, 100, 0), (3, 50, 50, 50, 300), (4, 20, 20, 80, 80), (5, 100, 100, 200, 150), (6, 900, 900, 901, 901), (7, 40, 200, 60, 201), (8, 0, 0, 100, 100)]
    got = {}
    for x in node_lines(spark.createDataFrame(lines, "id long, ax long, ay long, bx long, by long"), size=60).orderBy("id", "seq").collect():
        got.setdefault(x.id, [(x.ax, x.ay)]).append((x.bx, x.by))
    assert got[1] == got[8] == [(0, 0), (20, 20), (50, 50), (80, 80), (100, 100)]
    assert got[2] == [(0, 100), (50, 50), (100, 0)] and got[4] == [(20, 20), (50, 50), (80, 80)]
    assert got[3] == [(50, 50), (50, 200 + 1), (50, 300)] or got[3] == [(50, 50), (50, 200), (50, 300)]
    assert got[7][0] == (40, 200) and got[7][-1] == (60, 201) and got[7][1] == got[3][1]
    assert got[5] == [(100, 100), (200, 150)] and got[6] == [(900, 900), (901, 901)]


@pytest.mark.parametrize("leaf, entries", [(192, 2_000_000), (3, 50)])
def test_noding_of_a_heap(spark, monkeypatch, leaf, entries):
    """Many lines in a small place, against all pairs: no join lists them, and a line's rows in the search are its places; a repeated id, lines without an end."""
    from wayfare.operators import noding

    # tasks import the module anew, so the halving is held to small leaves here in the driver
    monkeypatch.setattr(noding, "LEAF", leaf)
    monkeypatch.setattr(noding, "ENTRIES", entries)
    r = random.Random(leaf)
    lines = [(i, *(r.randrange(-40, 40) for _ in range(4))) for i in range(140)] + [(5, -40, 3, 39, 4)]
    lines = [x for x in lines if x[1:3] != x[3:]]
    least = {}

    def cut(i, t, x, y):
        least[i, x, y] = min(t, least.get((i, x, y), 2.0))

    side = lambda p, q, z: (q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])
    for i, *p in lines:
        a, b = p[:2], p[2:]
        cut(i, 0.0, *a)
        cut(i, 1.0, *b)
        far = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        for j, *q in lines:
            c, d = q[:2], q[2:]
            c1, d1, a2, b2 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
            if i < j and c1 * d1 < 0 and a2 * b2 < 0:
                x, y = (a[k] + math.floor((b[k] - a[k]) * a2 / (a2 - b2) + 0.5) for k in (0, 1))
                cut(i, a2 / (a2 - b2), x, y)
                cut(j, c1 / (c1 - d1), x, y)
            for z, off in ((c, c1), (d, d1)) if i != j else ():
                along = (z[0] - a[0]) * (b[0] - a[0]) + (z[1] - a[1]) * (b[1] - a[1])
                if off * off <= far and 0 < along < far:
                    cut(i, along / far, *z)
    want, inside = set(), set()
    for i in {x[0] for x in lines}:
        at = [(x, y) for t, x, y in sorted((t, x, y) for (k, x, y), t in least.items() if k == i)]
        want |= {(i, n + 1, *a, *b) for n, (a, b) in enumerate(zip(at, at[1:]))}
    out = node_lines(spark.createDataFrame([*lines, (900, 1, None, 2, 3), (None, 1, 1, 30, 30)], "id long, ax long, ay long, bx long, by long"), size=32)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    rows = sorted(lines, key=lambda x: x[0])
    for box in ((x, x + 20, y, y + 20) for x in range(-40, 40, 20) for y in range(-40, 40, 20)):
        found = noding._meet(*(np.array(c) for c in zip(*rows)), box, 1)
        inside |= set(zip(*(c.tolist() for c in found)))
    assert inside == {(i, t, x, y) for (i, x, y), t in least.items()}


def test_polygons(spark):
    """Shares by sampling, hulls by their definition, points by crossing numbers."""
    r = random.Random(7)
    rows = []
    for i in range(40):
        n = r.randint(3, 9)
        angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(int(1000 * r.uniform(0.3, 1) * math.cos(a)), int(1000 * r.uniform(0.3, 1) * math.sin(a))) for a in angles]
        rows.append((i, ring, *(r.randrange(-1300, 1300) for _ in range(4))))
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:long,y:long>>, ux long, uy long, vx long, vy long")
    ends = tuple(F.col(c) for c in ("ux", "uy", "vx", "vy"))
    got = df.select("id", ring_share(ends, F.col("ring")).alias("in_share"), line_share(ends, F.col("ring"), F.lit(250)).alias("near_share"), hull(F.col("ring")).alias("corners"), in_ring(F.col("ux").cast("double"), F.col("uy").cast("double"), F.col("ring")).alias("inside")).collect()
    for x, (_, ring, ux, uy, vx, vy) in zip(sorted(got, key=lambda x: x.id), rows):
        turns = lambda px, py: sum((1 if b[1] > a[1] else -1) for a, b in zip(ring, ring[1:] + ring[:1]) if (a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0])  # noqa: B023, E731
        steps = [(ux + (k + 0.5) / 4000 * (vx - ux), uy + (k + 0.5) / 4000 * (vy - uy)) for k in range(4000)]
        assert abs(x.in_share - sum(turns(*p) != 0 for p in steps) / 4000) < 2e-3 and x.inside == (turns(ux, uy) != 0)

        def away(p):
            best = math.inf
            for a, b in zip(ring, ring[1:]):
                d = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
                t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d)) if d else 0
                best = min(best, math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))))
            return best

        assert abs(x.near_share - sum(away(p) <= 250 for p in steps) / 4000) < 2e-3
        side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        own = [(p.x, p.y) for p in x.corners]
        if len(set(ring)) >= 3:
            assert all(side(a, b, c) > 0 for a, b, c in zip(own, own[1:] + own[:1], own[2:] + own[:2]))
            assert all(side(a, b, p) >= 0 for a, b in zip(own, own[1:] + own[:1]) for p in ring)
