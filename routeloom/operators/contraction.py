"""Contraction hierarchies as DataFrames: no node, edge or shortcut list is held in one place.

Nodes are contracted in rounds. A round cuts the graph into blocks of bounded size and contracts
the inner nodes of each in one task; what is left is cut anew. Where blocks have few inner nodes, a
round takes all nodes whose priority (degree, then a hash) is least among their neighbours; they
are no neighbours of each other, so that all are contracted at once by joins. What is left of a
graph when it has few nodes is its core, an overlay of the whole with the same distances.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators import search
from routeloom.operators.tables import written


#: A task contracts no node with more neighbours than this, but leaves it.
MOST_NEIGHBOURS = 300
_PIECES = "kind int, block int, place int, tail bigint, head bigint, weight bigint"


def _inner(edges: DataFrame, core: int, size: int) -> DataFrame:
    """A round over blocks of about ``size`` edges: arcs from contracted inner nodes (kind 0) and to them
    (kind 1, the node as tail), and the edges left (kind 2); ``place`` is a node's turn in its block."""
    block, n = search.blocks_of(edges, size)
    e = edges.select(F.col("tail").cast("bigint").alias("tail"), F.col("head").cast("bigint").alias("head"), "weight")
    e = e.select(block("tail").alias("block"), block("head").alias("other"), "tail", "head", "weight")
    cross = F.col("block") != F.col("other")
    both = e.select("block", "tail", "head", "weight", cross.alias("cross"), F.lit(False).alias("back"))
    both = both.unionByName(e.where(cross).select(F.col("other").alias("block"), "tail", "head", "weight", F.lit(True).alias("cross"), F.lit(True).alias("back")))
    keep = core if n == 1 else 0

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        rows = list(zip(*(t.column(c).to_pylist() for c in ("tail", "head", "weight", "cross", "back")), strict=True))
        border = {h if back else u for u, h, _, crosses, back in rows if crosses}
        out: dict[int, dict[int, int]] = {}
        into: dict[int, dict[int, int]] = {}
        left = [(2, block, 0, u, h, w) for u, h, w, crosses, back in rows if crosses and not back]
        for u, h, w, crosses, _ in rows:
            if not crosses:
                for x in (u, h):
                    out.setdefault(x, {})
                    into.setdefault(x, {})
                out[u][h] = into[h][u] = w
        got = _shrunk(out, into, border, keep)
        got = [(kind, block, place, low, high, w) for kind, place, low, high, w in got]
        left += [(2, block, 0, u, h, w) for u in out for h, w in out[u].items()]
        columns = list(zip(*(got + left), strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "block", "place", "tail", "head", "weight"])

    return both.groupBy("block").applyInArrow(run, _PIECES)


def _shrunk(out: dict[int, dict[int, int]], into: dict[int, dict[int, int]], border: set[int], keep: int) -> list[tuple[int, int, int, int, int]]:
    """Contracts all nodes but ``keep`` and the border, by fewest neighbours; both tables keep the rest."""
    turn = dict(zip(sorted(out), np.random.default_rng(1).permutation(len(out)).tolist(), strict=True))
    size = lambda u: len(out[u].keys() | into[u].keys())
    queue = [(size(u), turn[u], u) for u in out if u not in border]
    heapq.heapify(queue)
    arcs, place = [], 0
    while queue and len(out) > keep:
        n, _, u = heapq.heappop(queue)
        if u not in out:
            continue
        now = size(u)
        if now != n:
            heapq.heappush(queue, (now, turn[u], u))
            continue
        if n > MOST_NEIGHBOURS:
            break
        o, i = out.pop(u), into.pop(u)
        for v in o:
            del into[v][u]
        for v in i:
            del out[v][u]
        arcs += [(0, place, u, v, w) for v, w in o.items()]
        arcs += [(1, place, u, v, w) for v, w in i.items()]
        place += 1
        for a, w1 in i.items():
            from_a = out[a]
            for b, w2 in o.items():
                w = w1 + w2
                if a == b or from_a.get(b, w + 1) <= w:
                    continue
                if n <= 12:
                    to_b = into[b]
                    if any(x + to_b[v] <= w for v, x in from_a.items() if v in to_b):
                        continue
                from_a[b] = into[b][a] = w
        for v in o.keys() | i.keys():
            if v not in border:
                heapq.heappush(queue, (size(v), turn[v], v))
    return arcs


def contract(edges: DataFrame, core: int = 64, size: int = search.BLOCK_EDGES) -> tuple[DataFrame, DataFrame]:
    """Arcs (low, high, weight, forward) of the contracted nodes, and the core (tail, head, weight).

    Of arcs, ``round``, ``block`` and ``place`` tell when their low node was contracted, for ``sweep``.

    A forward arc leads from the contracted node, the others to it. A shortcut is left out where
    an edge or two edges that stay are no longer (witnesses). Loops and null weights are no edges;
    of parallel edges the least counts. An empty table gives empty ones. Each round is a written
    table, and only counts reach the driver.
    """
    e = edges.where("tail <> head AND weight IS NOT NULL").groupBy("tail", "head").agg(F.min("weight").cast("bigint").alias("weight"))
    e, arcs, blocks = written(e, "contracted"), [], True
    kinds = {c: e.schema[c].dataType for c in ("tail", "head")}
    while True:
        ends = e.select("tail", "head").unionByName(e.select(F.col("head").alias("tail"), F.col("tail").alias("head"))).distinct()
        degree = ends.groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        order = written(degree.select("node", F.struct("n", F.xxhash64("node").alias("h"), "node").alias("p")), "order")
        nodes = order.count()
        if nodes <= core:
            break
        if blocks:
            pieces = written(_inner(e, core, size), "pieces")
            typed = lambda df, a, b: df.withColumn(a, F.col(a).cast(kinds["tail"])).withColumn(b, F.col(b).cast(kinds["head"]))
            gone = pieces.where("kind < 2").select("tail").distinct().count()
            if gone:
                a = pieces.where("kind < 2").select(F.col("tail").alias("low"), F.col("head").alias("high"), "weight", (F.col("kind") == 0).alias("forward"), F.lit(len(arcs)).alias("round"), "block", "place")
                arcs.append(typed(a, "low", "high"))
                e = written(typed(pieces.where("kind = 2").select("tail", "head", "weight"), "tail", "head"), "contracted")
            blocks = gone * 10 > nodes
            continue
        beside = ends.join(order, ends["head"] == order["node"]).groupBy("tail").agg(F.min("p").alias("least"))
        taken = written(order.join(beside, order["node"] == beside["tail"]).where("p < least").select("node"), "taken")
        out = e.join(taken, e["tail"] == taken["node"]).select(F.col("tail").alias("low"), F.col("head").alias("high"), "weight", F.lit(True).alias("forward"))
        into = e.join(taken, e["head"] == taken["node"]).select(F.col("head").alias("low"), F.col("tail").alias("high"), "weight", F.lit(False).alias("forward"))
        spread = F.pmod(F.xxhash64("low"), F.lit(64)).cast("int")
        arcs.append(written(out.unionByName(into).select("*", F.lit(len(arcs)).alias("round"), spread.alias("block"), F.lit(0).alias("place")), "arcs"))
        a = arcs[-1]
        i, o = a.where("NOT forward").select("low", F.col("high").alias("tail"), F.col("weight").alias("w1")), a.where("forward").select("low", F.col("high").alias("head"), F.col("weight").alias("w2"))
        short = i.join(o, "low").where("tail <> head").groupBy("tail", "head").agg(F.min(F.col("w1") + F.col("w2")).alias("weight"))
        short = written(short, "shortcuts")
        gone = taken.withColumnRenamed("node", "gone")
        rest = written(e.join(gone, F.col("tail") == F.col("gone"), "left_anti").join(gone, F.col("head") == F.col("gone"), "left_anti"), "rest")
        first, second = rest.select("tail", F.col("head").alias("via"), F.col("weight").alias("w1")), rest.select(F.col("tail").alias("via"), "head", F.col("weight").alias("w2"))
        seen = short.join(first, "tail").join(second, ["via", "head"]).where(F.col("w1") + F.col("w2") <= F.col("weight")).select("tail", "head").distinct()
        kept = short.join(seen, ["tail", "head"], "left_anti")
        e = written(rest.select("tail", "head", "weight").unionByName(kept).groupBy("tail", "head").agg(F.min("weight").alias("weight")), "contracted")
    empty = e.select(F.col("tail").alias("low"), F.col("head").alias("high"), "weight", F.lit(True).alias("forward"), *[F.lit(0).alias(c) for c in ("round", "block", "place")]).limit(0)
    return reduce(DataFrame.unionByName, arcs, empty), e


def labels(nodes: DataFrame, arcs: DataFrame, core: DataFrame, forward: bool) -> DataFrame:
    """Hub labels (node, hub, d) of ``nodes`` (node), for ``search.label_distances``: the nodes found
    upwards from each, or that lead down to it; forward ones also lead through the core. For labels
    of few nodes: distances to all nodes are found by ``sweep``."""
    e = arcs.where(F.col("forward") == forward).select(F.col("low").alias("tail"), F.col("high").alias("head"), "weight")
    found = search.distances(e, nodes.select(F.col("node").alias("source"))).select(F.col("source").alias("node"), F.col("node").alias("hub"), F.col("dist").alias("d"))
    if not forward:
        return found
    inner = core.select(F.col("tail").alias("source")).union(core.select("head")).distinct()
    through = search.distances(core, found.select(F.col("hub").alias("source")).join(inner, "source").distinct())
    through = through.select(F.col("source").alias("enter"), F.col("node").alias("leave"), "dist")
    wide = found.join(through, found["hub"] == through["enter"]).select("node", F.col("leave").alias("hub"), (F.col("d") + F.col("dist")).alias("d"))
    return written(found.unionByName(wide).groupBy("node", "hub").agg(F.min("d").alias("d")), "labels")


def sweep(arcs: DataFrame, out: DataFrame) -> DataFrame:
    """source, node, dist: distances from the nodes of forward labels ``out`` to all that they reach.

    Rounds of contraction are undone from the last to the first: what a round took away is reached
    over nodes that outlived it, so that a task needs the labels of its block and of its border.
    A round has at least as many labels as all later ones where rounds shrink the graph.
    """
    known = written(out.select(F.col("node").alias("source"), F.col("hub").alias("node"), F.col("d").alias("dist")), "known")
    last = arcs.agg(F.max("round")).first()[0]
    parts = max(1, -(-known.select("source").distinct().count() // search.BLOCK_SOURCES))
    part = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    names = {c: known.schema[c].dataType for c in ("source", "node")}

    def run(key, a: pa.Table, k: pa.Table) -> pa.Table:
        low, high, w, place = (a.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "weight", "place"))
        source, node, dist = (k.column(c).to_numpy().astype(np.int64) for c in ("source", "node", "dist"))
        nodes, sources = np.unique(np.concatenate([low, high, node])), np.unique(source)
        far = np.int64(1 << 61)
        label = np.full((len(nodes), len(sources)), far)
        label[np.searchsorted(nodes, node), np.searchsorted(sources, source)] = dist
        order = np.lexsort((low, -place))
        low, high, w = np.searchsorted(nodes, low)[order], np.searchsorted(nodes, high)[order], w[order, None]
        cuts = np.flatnonzero(np.diff(low, prepend=-1, append=-1)).tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            u = low[x]
            np.minimum(label[u], (label[high[x:y]] + w[x:y]).min(axis=0), out=label[u])
        mine = np.unique(low)
        r, c = np.nonzero(label[mine] < far)
        return pa.table([pa.array(v) for v in (sources[c], nodes[mine][r], label[mine][r, c])], names=["source", "node", "dist"])

    for k in range(last if last is not None else -1, -1, -1):
        a = arcs.where((F.col("round") == k) & ~F.col("forward")).select("block", "low", "high", "weight", "place")
        ends = a.select("block", F.col("high").alias("node")).union(a.select("block", "low")).distinct()
        asked = known.join(ends, "node").select("block", part.alias("part"), "source", "node", "dist")
        each = a.join(asked.select("block", "part").distinct(), "block").select(*[F.col(c).alias(c) for c in ("block", "part", "low", "high", "weight", "place")])
        found = each.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(run, "source bigint, node bigint, dist bigint")
        found = found.select(*[F.col(c).cast(t).alias(c) for c, t in names.items()], "dist")
        known = written(known.unionByName(found).groupBy("source", "node").agg(F.min("dist").alias("dist")), "known")
    return known


def label_nearest(sources: DataFrame, targets: DataFrame, out: DataFrame, into: DataFrame, k: int) -> DataFrame:
    """source, node, dist, rank: the k nearest targets through hubs; ties by node.

    A hub's bucket is cut to its k nearest targets, which hold the k nearest of any source that
    comes through it, so that no source meets all targets.
    """
    from pyspark.sql import Window

    bucket = targets.join(into, targets["target"] == into["node"]).select("hub", "target", F.col("d").alias("d2"))
    bucket = bucket.withColumn("place", F.row_number().over(Window.partitionBy("hub").orderBy("d2", "target"))).where(F.col("place") <= k)
    met = sources.join(out, sources["source"] == out["node"]).select("source", "hub", "d").join(bucket, "hub")
    dist = met.groupBy("source", "target").agg(F.min(F.col("d") + F.col("d2")).alias("dist"))
    w = Window.partitionBy("source").orderBy("dist", "target")
    return dist.select("source", F.col("target").alias("node"), "dist", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
