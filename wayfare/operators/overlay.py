"""Cheapest paths of many requests at once, over a network of any size.

Space is halved into cells until none holds more than max_edges edges. A cell is
one row: its nodes and edges as arrays. All requests then search together: a
round takes every improved label (request, node where a path enters a cell,
total) through its cell and gives the labels at the nodes of other cells that
its edges lead to, so there are about as many rounds as cells on a path. Only
the cells that a path crosses are searched again, for its edges.

A request may be kept to an ellipse around its ends: it goes on only over nodes
inside. A task holds one cell and searches it for a few requests, one after
another; nothing of a request but its labels is held together.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.graph import in_ellipse
from wayfare.operators.spatial import box_cells, meet_in_cells
from wayfare.session import settle, settle_round, ship

#: Halvings of both axes, at most.
DEPTH = 12
#: Of those, the ones that are counted over few squares.
TOP = 6


def _code(x: Column, y: Column, origin: tuple[int, int], width: int) -> Column:
    """Z-order code of a point's finest cell."""
    qx, qy = (F.floor((c - o) / width).cast("long") for c, o in ((x, origin[0]), (y, origin[1])))
    out = F.lit(0).cast("long")
    for i in range(DEPTH):
        bit = lambda q: F.shiftright(q, i).bitwiseAND(F.lit(1).cast("long"))  # noqa: E731, B023
        out = out + F.shiftleft(bit(qx), 2 * i) + F.shiftleft(bit(qy), 2 * i + 1)
    return out


def cut_into_cells(edges: DataFrame, max_edges: int) -> DataFrame:
    """edges (u, v, cost, ux, uy, vx, vy) with ucell and vcell: quarters of quarters, of max_edges starts each at most.

    Only points that share a finest cell, one part in 4096 of the extent each way, can make a cell larger.
    """
    e = edges.agg(*[F.min(F.least(f"u{c}", f"v{c}")).alias(f"lo_{c}") for c in "xy"], *[F.max(F.greatest(f"u{c}", f"v{c}")).alias(f"hi_{c}") for c in "xy"]).first()
    if e["lo_x"] is None:
        return edges.withColumns({"ucell": F.lit(0).cast("long"), "vcell": F.lit(0).cast("long")})
    width = max(e["hi_x"] - e["lo_x"], e["hi_y"] - e["lo_y"]) // (1 << DEPTH) + 1
    origin = (e["lo_x"], e["lo_y"])
    coded = edges.withColumns({"_u": _code(F.col("ux"), F.col("uy"), origin, width), "_v": _code(F.col("vx"), F.col("vy"), origin, width)})
    ends = coded.select(F.col("_u").alias("code"), F.lit(1).alias("n")).unionByName(coded.select(F.col("_v").alias("code"), F.lit(0).alias("n")))
    leaves = settle(ends.groupBy("code").agg(F.sum("n").alias("n")).withColumn("top", F.expr(f"shiftright(code, 2 * {DEPTH - TOP})")))
    # the upper levels are counted over at most 4 ** TOP squares; the lower ones only in those that are still too large
    top = settle(_first_small(leaves.groupBy("top").agg(F.sum("n").alias("n")), "top", 0, TOP, max_edges))
    low = settle(_first_small(leaves.join(top.filter("cell IS NULL").select("top"), "top"), "code", TOP + 1, DEPTH, max_edges))
    small, many = F.broadcast(top.filter("cell IS NOT NULL")), not low.isEmpty()
    for c in "uv":
        coded = coded.withColumn("top", F.expr(f"shiftright(_{c}, 2 * {DEPTH - TOP})")).join(small.withColumnRenamed("cell", "_top"), "top", "left").drop("top")
        if many:
            coded = coded.join(low.toDF(f"_{c}", "_low"), f"_{c}", "left").withColumn("_top", F.coalesce("_top", "_low")).drop("_low")
        coded = coded.withColumnRenamed("_top", f"{c}cell")
    return coded.drop("_u", "_v")


def _first_small(counts: DataFrame, code: str, lo: int, hi: int, max_edges: int) -> DataFrame:
    """Each code of level hi (of its table, n edges) with the first square of levels lo to hi around it that holds at most max_edges;
    the last level's own if none does and it is the finest, else null."""
    levels = counts.select(code, "n", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("level")).withColumn("prefix", F.expr(f"shiftright({code}, 2 * ({hi} - level))"))
    sizes = levels.groupBy("level", "prefix").agg(F.sum("n").alias("all")).withColumn("small", (F.col("all") <= max_edges) | (F.col("level") == DEPTH))
    first = F.min(F.when(F.col("small"), F.struct("level", "prefix"))).alias("c")
    return levels.join(sizes, ["level", "prefix"]).groupBy(code).agg(first).select(code, F.expr(f"c.prefix * {DEPTH + 1} + c.level").alias("cell"))


#: No way; two of it still fit into 64 bits.
FAR = 1 << 61
#: Requests that share a copy of a cell in a round, about.
SHARE = 4
CELL = "cell long, node binary, x binary, y binary, at binary, first binary, head binary, cost binary"
LABEL = "request_id long, node long, cell long, total long, from_cell long, a long, b long"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cell's edges as one row: its nodes and those that its edges lead to, and each node's edges in a row."""
    col = {c: pdf[c].to_numpy(np.int64) for c in ("u", "v", "cost", "vcell", "ux", "uy", "vx", "vy")}
    both = lambda a, b: np.concatenate([a, b])
    node, at = np.unique(both(col["u"], col["v"]), return_index=True)
    tail = np.searchsorted(node, col["u"])
    order = np.argsort(tail, kind="stable")
    cells = both(pdf["ucell"].to_numpy(np.int64), col["vcell"])[at]
    out = {"node": node, "x": both(col["ux"], col["vx"])[at], "y": both(col["uy"], col["vy"])[at], "at": cells, "first": np.searchsorted(tail[order], np.arange(len(node) + 1)), "head": np.searchsorted(node, col["v"])[order], "cost": col["cost"][order]}
    return pd.DataFrame({"cell": [int(pdf["ucell"].iloc[0])], **{k: [v.astype(np.int64).tobytes()] for k, v in out.items()}})


def _search(factor: float, least: float, slack: float):
    """Of a round's labels in one cell: the labels that they give beyond the cell, and at the target."""

    def run(labels: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(labels) and len(cells):
            cell, *rest = cells[["at_cell", "node", "x", "y", "at", "first", "head", "cost"]].itertuples(index=False, name=None).__next__()
            node, x, y, at, first, head, cost = (np.frombuffer(z, np.int64) for z in rest)
            edges = first.tolist(), head.tolist(), cost.tolist()
            abroad = np.flatnonzero(at != cell).tolist()
            for request, own in labels.groupby("request_id"):
                target, sx, sy, tx, ty, so_far = (int(own[c].iloc[0]) for c in ("target", "sx", "sy", "tx", "ty", "so_far"))
                d = lambda ax, ay: np.sqrt((x - ax).astype(float) ** 2 + (y - ay).astype(float) ** 2)
                far = d(tx, ty)
                held = d(sx, sy) + far <= np.sqrt(float(tx - sx) ** 2 + float(ty - sy) ** 2) * factor
                # what can't beat the best path to the target so far ends here; one is taken off for rounding
                room = (so_far if not slack else int(so_far / (1 + slack)) + 1) - np.maximum(np.floor(far * least) - 1, 0).astype(np.int64)
                cap = np.where(held, room, -1).tolist()
                place = np.searchsorted(node, target)
                goal = int(place) if place < len(node) and node[place] == target else -1
                starts = own["node"].to_numpy(np.int64)
                where = np.minimum(np.searchsorted(node, starts), len(node) - 1)
                known = node[where] == starts
                best, start, prev = _reach(edges, cap, goal, where[known].tolist(), own["total"].to_numpy(np.int64)[known].tolist())
                out += [(request, int(node[k]), int(at[k]), best[k], cell, int(node[start[k]]), int(node[prev[k]])) for k in abroad if k != goal and best[k] < FAR]
                if goal >= 0 and best[goal] < FAR:
                    out.append((request, target, -1, best[goal], cell, int(node[start[goal]]), int(node[prev[goal]])))
        return pd.DataFrame(out, columns=["request_id", "node", "cell", "total", "from_cell", "a", "b"]).astype("int64")

    return run


def _reach(edges: tuple[list, list, list], cap: list[int], goal: int, starts: list[int], totals: list[int]) -> tuple[list, list, list]:
    """Least totals from the starts under each node's cap (FAR if none), and for each the start and the node before it."""
    first, head, cost = edges
    best, start, prev = [FAR] * len(cap), [-1] * len(cap), [-1] * len(cap)
    queue = []
    for s, t in zip(starts, totals):
        if t < cap[s] and t < best[s]:
            best[s], start[s], prev[s] = t, s, s
            queue.append((t, s))
    heapq.heapify(queue)
    while queue:
        t, k = heapq.heappop(queue)
        if t > best[k]:
            continue
        if k == goal:
            break
        s = start[k]
        for i in range(first[k], first[k + 1]):
            n, h = t + cost[i], head[i]
            if n < best[h] and n < cap[h]:
                best[h], start[h], prev[h] = n, s, k
                heapq.heappush(queue, (n, h))
    return best, start, prev


def _spread(out: dict[int, list[tuple[int, int]]], start: int, goal: int) -> dict[int, int]:
    """The node before each on cheapest paths from start, until the goal is reached."""
    best, prev, done = {start: 0}, {}, set()
    queue = [(0, start)]
    while queue and goal not in done:
        cost, x = heapq.heappop(queue)
        if x in done:
            continue
        done.add(x)
        for y, c in out.get(x, ()):
            n = cost + c
            if n < best.get(y, FAR):
                best[y], prev[y] = n, x
                heapq.heappush(queue, (n, y))
    return prev


def _inside(pdf: pd.DataFrame) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    own = pdf[pdf["kind"] == "edge"]
    for u, v, c in zip(own["u"].tolist(), own["v"].tolist(), own["cost"].tolist()):
        out.setdefault(u, []).append((v, c))
    return out


def _own_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of the parts of paths that lie in one cell."""
    out, rows = _inside(pdf), []
    parts = pdf[pdf["kind"] == "part"]
    for hop, a, b in zip(parts["cost"].tolist(), parts["u"].tolist(), parts["v"].tolist()):
        prev = _spread(out, a, b)
        path = []
        while b != a:
            path.append((prev[b], b))
            b = prev[b]
        rows += [(hop, k, u, v) for k, (u, v) in enumerate(reversed(path))]
    return pd.DataFrame({"request_id": [pdf["request_id"].iloc[0]] * len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(("hop", "k", "u", "v"))}}).astype("int64")


def _places(requests: DataFrame, cut: DataFrame, factor: float, size: int) -> DataFrame:
    """request_id and cell: cells whose box meets the box of a request's ellipse."""
    boxes = cut.groupBy(F.col("ucell").alias("cell")).agg(F.min("ux").alias("x0"), F.max("ux").alias("x1"), F.min("uy").alias("y0"), F.max("uy").alias("y1"))
    reach = F.ceil(F.sqrt(F.pow((F.col("tx") - F.col("sx")).cast("double"), F.lit(2)) + F.pow((F.col("ty") - F.col("sy")).cast("double"), F.lit(2))) * (factor / 2))
    mid = lambda c: (F.col(f"s{c}") + F.col(f"t{c}")) / 2
    r = requests.withColumn("_c", box_cells(F.floor(mid("x") - reach), F.ceil(mid("x") + reach), F.floor(mid("y") - reach), F.ceil(mid("y") + reach), size)).select("request_id", "_c.cx", "_c.cy")
    b = boxes.withColumn("_c", box_cells(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), size)).select("cell", "_c.cx", "_c.cy")
    return meet_in_cells(r, b).select("request_id", "cell").distinct()


def _hops(reached: DataFrame, fronts: list[DataFrame]) -> DataFrame:
    """request_id, hop, cell, a, b, next: the parts of the paths, back from the targets, a round a step."""
    spark, label = reached.sparkSession, ["request_id", "node", "cell", "born", "from_cell", "a", "b"]
    reached, found, step = reached.select(*label), [], None
    for born in range(len(fronts), 0, -1):
        here = reached.filter(F.col("born") == born)
        if step is not None:
            before = fronts[born].select(*label)
            here = here.unionByName(before.join(step.select("request_id", F.col("a").alias("node"), F.col("from_cell").alias("cell")), ["request_id", "node", "cell"], "left_semi"))
        step = settle_round(here)
        found.append(step.select("request_id", F.col("born").alias("hop"), F.col("from_cell").alias("cell"), "a", "b", F.col("node").alias("next")))
    out = spark.createDataFrame([], "request_id long, hop int, cell long, a long, b long, next long")
    for each in found:
        out = out.unionByName(each)
    return out


def overlay_paths(
    requests: DataFrame, edges: DataFrame, factor: float = 1.5, least: float = 0.0, slack: float = 0.0, expand: bool = True,
    max_edges: int = 400_000, grid: int = 10_000, max_rounds: int = 10_000,
) -> DataFrame:
    """request_id, seq, u, v, total: the edges of a cheapest path for each request inside its ellipse; without expand, only request_id and total.

    requests: request_id, source, target and their places sx, sy, tx, ty. edges: u, v, cost (not negative) and the
    places ux, uy, vx, vy. `least` bounds the cost of a unit of distance from below and only saves work. With a
    slack e, totals are at most 1 + e times the cheapest. A request without a path gets one row with nulls; one from
    a node to itself gets total 0.
    """
    ship(requests.sparkSession)
    requests = settle(requests.select("request_id", "source", "target", "sx", "sy", "tx", "ty"))
    edges = settle(edges.select("u", "v", F.col("cost").cast("long").alias("cost"), *[F.col(c).cast("long").alias(c) for c in ("ux", "uy", "vx", "vy")]))
    cut = settle(cut_into_cells(edges, max_edges))
    asked = requests.filter("source <> target")
    wanted = _places(asked, cut, factor, grid).select("cell").distinct()
    cells = settle_round(cut.join(wanted.withColumnRenamed("cell", "ucell"), "ucell", "left_semi").groupBy("ucell").applyInPandas(_pack, CELL))
    slots = max(1, asked.count() // SHARE)
    goal = asked.select("request_id", "target", "sx", "sy", "tx", "ty", F.pmod(F.xxhash64("request_id"), F.lit(slots)).alias("slot"))

    # labels: the least total known at a node where a path enters a cell, and the round that found it
    at = cut.select(F.col("u").alias("node"), F.col("ucell").alias("cell")).unionByName(cut.select(F.col("v").alias("node"), F.col("vcell").alias("cell")))
    start = at.join(asked.select("request_id", F.col("source").alias("node")), "node").groupBy("request_id", "node").agg(F.first("cell").alias("cell"))
    none = [F.lit(0).cast("long").alias(c) for c in ("total", "from_cell", "a", "b")]
    known = settle_round(start.select("request_id", "node", "cell", *none, F.lit(0).alias("born")))
    fronts: list[DataFrame] = []
    for born in range(1, max_rounds + 1):
        front = known.filter((F.col("born") == born - 1) & (F.col("cell") >= 0))
        if front.isEmpty():
            break
        fronts.append(front)
        found = known.filter("cell = -1").select("request_id", F.col("total").alias("so_far"))
        labels = front.select("request_id", "node", "cell", "total").join(goal, "request_id").join(found, "request_id", "left").withColumn("so_far", F.coalesce("so_far", F.lit(FAR)))
        active = cells.toDF("at_cell", *cells.columns[1:]).join(labels.select(F.col("cell").alias("at_cell"), F.col("slot").alias("at_slot")).distinct(), "at_cell")
        new = labels.groupBy("cell", "slot").cogroup(active.groupBy("at_cell", "at_slot")).applyInPandas(_search(factor, least, slack), LABEL)
        both = known.unionByName(new.withColumn("born", F.lit(born)))
        rest = ["total", "born", "from_cell", "a", "b"]
        best = both.groupBy("request_id", "node", "cell").agg(F.min(F.struct(*rest)).alias("x"))
        known = settle_round(best.select("request_id", "node", "cell", "x.*"))
    else:
        raise RuntimeError(f"paths did not settle in {max_rounds} rounds")

    reached = known.filter("cell = -1")
    out = requests.select("request_id", (F.col("source") == F.col("target")).alias("_same")).join(reached.select("request_id", "total"), "request_id", "left")
    out = out.select("request_id", F.when(F.col("_same"), 0).otherwise(F.col("total")).cast("long").alias("total"))
    if not expand:
        return out
    hops = settle(_hops(reached, fronts))
    columns = ["request_id", "cell", "kind", "u", "v", "cost", "vcell", "vx", "vy"]
    parts = hops.filter("a <> b").select("request_id", "cell", F.lit("part").alias("kind"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("hop").cast("long").alias("cost"), *[F.lit(0).cast("long").alias(c) for c in ("vcell", "vx", "vy")])
    crossed = parts.select("request_id", "cell").distinct().join(asked, "request_id")
    within = lambda x, y: in_ellipse(F.col(x), F.col(y), *[F.col(c) for c in ("sx", "sy", "tx", "ty")], factor)
    again = cut.filter("ucell = vcell").withColumns({"cell": F.col("ucell"), "kind": F.lit("edge")}).join(crossed, "cell").filter(within("ux", "uy") & within("vx", "vy")).select(*columns)
    inner = again.unionByName(parts.select(*columns)).groupBy("request_id", "cell").applyInPandas(_own_edges, "request_id long, hop long, k long, u long, v long")
    over = hops.filter("b <> next").select("request_id", F.col("hop").cast("long").alias("hop"), F.lit(1 << 40).alias("k"), F.col("b").alias("u"), F.col("next").alias("v"))
    each = inner.unionByName(over).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("hop", "k", "u", "v"))).alias("e"))  # one path
    each = each.select("request_id", F.posexplode("e").alias("seq", "e")).select("request_id", "seq", "e.u", "e.v")
    return out.join(each, "request_id", "left").select("request_id", "seq", "u", "v", "total")
