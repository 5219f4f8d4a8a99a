"""Shortest paths: iterated DataFrames, label joins, and kernels over a bounded graph.

Four forms give the same answers. ``relax`` iterates a join and a ``min`` and never holds
the graph in one place; its rounds are the edges of the longest path. ``distances`` holds a block
of the graph in a task; its rounds are the blocks on a path. ``dijkstra`` sends queries to tasks that each hold a compact graph;
it asks for a graph of a checked size. ``label_distances`` joins precomputed labels.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.operators.tables import written

#: A graph is sent to every task up to this many edges (24 bytes each in ``Graph``'s arrays, beside
#: its nodes, and ten times that for points of functions); a larger one is searched by ``relax``.
MAX_BROADCAST_EDGES = 20_000_000
MAX_BROADCAST_POINTS = 4_000_000
#: Edges of a block of ``distances`` and sources that a task searches it from: some 100 MB.
BLOCK_EDGES = 250_000
BLOCK_SOURCES = 32


def relax(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000, weight: str = "weight") -> DataFrame:
    """source, node, dist: shortest distances from every row of ``sources`` (source).

    ``edges`` has tail, head and a weight that isn't negative; a null weight is no edge. A
    round extends only labels that changed in the last one. Each round is a written table
    (or a checkpoint), so that plans stay short and a lost executor costs one read.
    """
    e = edges.where(F.col(weight).isNotNull()).groupBy("tail", "head").agg(F.min(weight).alias("w"))
    e = written(e.select("tail", "head", "w"), "edges")
    best = written(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("dist")).distinct(), "dist")
    front = best
    for _ in range(max_rounds):
        step = front.join(e, front["node"] == e["tail"]).groupBy("source", F.col("head").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        joined = best.join(step, ["source", "node"], "full").select("source", "node", F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("changed"))
        both = written(joined, "dist")
        best, front = both.drop("changed"), both.where("changed").drop("changed")
        if front.limit(1).count() == 0:
            return best
    raise RuntimeError(f"distances still change after {max_rounds} rounds")


def blocks_of(edges: DataFrame, size: int) -> tuple[Callable[[str], Column], int]:
    """Ranges of node ids with about ``size`` edges each: a column's block, and their number.

    Any ranges do; neighbours with near ids make fewer edges between blocks."""
    n = -(-edges.count() // size)
    cuts = np.unique(edges.approxQuantile("tail", [k / n for k in range(1, n)], 0.2 / n)) if n > 1 else np.array([])
    if not len(cuts):
        return lambda c: F.lit(0), 1
    find = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy(), side="left").astype(np.int32)), "int")
    return lambda c: find(F.col(c).cast("bigint")), len(cuts) + 1


def distances(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000, size: int = BLOCK_EDGES) -> DataFrame:
    """As ``relax`` for whole-number ids, but each block of the graph is searched by one task at a time.

    Entries are the labels of sources and of nodes that edges from other blocks lead to. A round
    searches the blocks with new entries, from those sources that they are of, and gives entries of
    other blocks; the tables of the rounds hold nothing else. When no entry changes, one pass over
    all blocks gives the distances. Raises if entries still change after ``max_rounds``.
    """
    e = edges.where(F.col("weight").isNotNull()).groupBy("tail", "head").agg(F.min("weight").cast("bigint").alias("w"))
    kind = {f.name: f.dataType for f in edges.schema}["head"]
    e = written(e.select(F.col("tail").cast("bigint").alias("tail"), F.col("head").cast("bigint").alias("head"), "w"), "edges")
    block, _ = blocks_of(e, size)
    e = written(e.select(block("tail").alias("block"), "tail", "head", "w", block("head").alias("into")), "blocks")
    n = sources.select("source").distinct()
    parts = min(max(n.count(), 1), 1 << 30)
    parts = max(min(parts, 64), -(-parts // BLOCK_SOURCES))
    part = F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")
    entries = n.select(F.col("source").cast("bigint").alias("source")).select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("dist"))
    entries = written(entries.select(block("node").alias("block"), part.alias("part"), "source", "node", "dist"), "entries")
    changed, key = entries, ["block", "part"]
    for _ in range(max_rounds):
        active = changed.select(*key, "source").distinct()
        asked = entries.join(active, [*key, "source"], "left_semi")
        found = _searched(asked, e.join(changed.select(*key).distinct(), "block"), True)
        found = found.groupBy("block", "source", "node").agg(F.min("dist").alias("new")).select("block", part.alias("part"), "source", "node", "new")
        on = [*key, "source", "node"]
        both = entries.join(found, on, "full").select(*on, F.least("dist", "new").alias("dist"), (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("changed"))
        both = written(both, "entries")
        entries, changed = both.drop("changed"), both.where("changed").drop("changed")
        if changed.limit(1).count() == 0:
            whole = _searched(entries, e.join(entries.select(*key).distinct(), "block"), False)
            return written(whole.select(F.col("source").cast(sources.schema["source"].dataType).alias("source"), F.col("node").cast(kind).alias("node"), "dist"), "dist")
    raise RuntimeError(f"distances still change after {max_rounds} rounds")


def _searched(entries: DataFrame, edges: DataFrame, out: bool) -> DataFrame:
    """Labels (block, source, node, dist) inside of blocks, or of nodes that edges lead out to."""

    def run(key, e: pa.Table, a: pa.Table) -> pa.Table:
        block = key[0].as_py()
        tail, head, w, into = (e.column(c).to_numpy() for c in ("tail", "head", "w", "into"))
        source, node, dist = (a.column(c).to_numpy() for c in ("source", "node", "dist"))
        inner = into == block
        nodes = np.unique(np.concatenate([tail, head[inner], node]))
        t, h = np.searchsorted(nodes, tail[inner]), np.searchsorted(nodes, head[inner])
        order = np.argsort(t, kind="stable")
        first = np.searchsorted(t[order], np.arange(len(nodes) + 1)).tolist()
        h, cost = h[order].tolist(), w[inner][order].tolist()
        leave, far, over = np.searchsorted(nodes, tail[~inner]), head[~inner], w[~inner]
        start = np.searchsorted(nodes, node)
        parts: list[list] = [[], [], [], []]
        for s in np.unique(source).tolist():
            mine = source == s
            label = _settled(first, h, cost, list(zip(dist[mine].tolist(), start[mine].tolist(), strict=True)), len(nodes))
            if out:
                ends = label[leave] >= 0
                row = (into[~inner][ends], far[ends], label[leave][ends] + over[ends])
            else:
                ends = label >= 0
                row = (np.full(int(ends.sum()), block), nodes[ends], label[ends])
            for p, x in zip(parts, (row[0], np.full(len(row[0]), s), *row[1:]), strict=True):
                p.append(x)
        b, s, v, d = (np.concatenate(p) if p else np.array([], np.int64) for p in parts)
        return pa.table([pa.array(b.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (s, v, d))], names=["block", "source", "node", "dist"])

    anew = edges.select(*[F.col(c).alias(c) for c in edges.columns])  # else its keys are the entries'
    both = anew.groupBy("block", "part").cogroup(entries.groupBy("block", "part"))
    return both.applyInArrow(run, "block int, source bigint, node bigint, dist bigint")


def _settled(first: list[int], head: list[int], cost: list[int], queue: list[tuple[int, int]], n: int) -> np.ndarray:
    """Labels of ``n`` nodes by a search from the labelled ones in ``queue``; -1 where none leads."""
    heapq.heapify(queue)
    best = [-1] * n
    for d, u in sorted(queue, reverse=True):
        best[u] = d
    while queue:
        d, u = heapq.heappop(queue)
        if d > best[u]:
            continue
        for k in range(first[u], first[u + 1]):
            v, new = head[k], d + cost[k]
            if best[v] < 0 or new < best[v]:
                best[v] = new
                heapq.heappush(queue, (new, v))
    return np.array(best, np.int64)


def parents(edges: DataFrame, dist: DataFrame, weight: str = "weight") -> DataFrame:
    """source, node, parent: the last node before each on a shortest path, the smallest of equals."""
    a, b = dist.alias("a"), dist.alias("b")
    tight = a.join(edges.alias("e"), F.col("a.node") == F.col("e.tail")).join(b, (F.col("b.source") == F.col("a.source")) & (F.col("b.node") == F.col("e.head")) & (F.col("b.dist") == F.col("a.dist") + F.col(f"e.{weight}")))
    return tight.where("b.node <> b.source").groupBy("b.source", "b.node").agg(F.min("a.node").alias("parent"))


class Graph:
    """Compressed rows of a graph whose nodes are numbered from 0, for kernels."""

    def __init__(self, tail: np.ndarray, head: np.ndarray, edge: np.ndarray, weight: np.ndarray | None = None, points: list | None = None) -> None:
        self.nodes, inverse = np.unique(np.concatenate([tail, head]), return_inverse=True)
        t, h = inverse[: len(tail)], inverse[len(tail) :]
        order = np.lexsort((edge, h, t))
        # Arrays of the array module: as small as numpy's, and single numbers are read faster.
        whole = lambda x: array("q", np.ascontiguousarray(x, np.int64).tobytes())
        self.first = whole(np.searchsorted(t[order], np.arange(len(self.nodes) + 1)))
        self.head, self.edge = whole(h[order]), whole(edge[order])
        self.weight = None if weight is None else whole(weight[order]) if np.issubdtype(np.asarray(weight).dtype, np.integer) else array("d", np.ascontiguousarray(weight[order], float).tobytes())
        self.points = None if points is None else [points[i] for i in order]
        self.number = {int(n): k for k, n in enumerate(self.nodes)}

    def search(self, source: int, target: int | None, cost: Callable[[int, float], float | None], start: float = 0, stop: Callable[[int], bool] | None = None) -> tuple[dict[int, float], dict[int, tuple[int, int]], list[int]]:
        """Label-setting search; ``cost`` gives an edge's cost at a time, None where it is closed.

        Returns labels of settled nodes, parents (node, edge place) and the settling order.
        """
        s = self.number.get(source)
        t = None if target is None else self.number.get(target, -1)
        if s is None:
            return {}, {}, []
        best, parent, done, order, queue = {s: start}, {}, set(), [], [(start, s)]
        while queue:
            d, u = heapq.heappop(queue)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            if u == t or (stop and stop(u)):
                break
            for k in range(self.first[u], self.first[u + 1]):
                c = cost(k, d)
                if c is not None:
                    v, new = self.head[k], d + c
                    if v not in best or new < best[v]:
                        best[v], parent[v] = new, (u, k)
                        heapq.heappush(queue, (new, v))
        return {u: best[u] for u in order}, parent, order

    def path(self, parent: dict[int, tuple[int, int]], source: int, target: int) -> tuple[list[int], list[int]]:
        u, nodes, edges = self.number[target], [], []
        while u in parent and int(self.nodes[u]) != source:
            nodes.append(int(self.nodes[u]))
            u, k = parent[u]
            edges.append(self.edge[k])
        return [int(self.nodes[u]), *reversed(nodes)], list(reversed(edges))


def load_graph(edges: DataFrame, points: DataFrame | None = None, weight: str = "weight", max_edges: int = MAX_BROADCAST_EDGES) -> Graph:
    """The graph on the driver, to be broadcast, after a check of its size.

    ``points`` (edge_id, at, val) makes it time-dependent. Raises ValueError beyond
    ``max_edges``; use ``relax`` there.
    """
    n, p = edges.count(), points.count() if points is not None else 0
    if n > max_edges or p > MAX_BROADCAST_POINTS:
        raise ValueError(f"{n} edges and {p} points are too many to broadcast; use relax()")
    rows = edges.where(F.col(weight).isNotNull()).select("edge_id", "tail", "head", F.col(weight).alias("w")).toPandas() if points is None else edges.select("edge_id", "tail", "head").toPandas()
    tail, head, edge = (rows[c].to_numpy(np.int64) for c in ("tail", "head", "edge_id"))
    if points is None:
        return Graph(tail, head, edge, rows["w"].to_numpy(np.int64))
    p = points.select("edge_id", "at", "val").toPandas().sort_values(["edge_id", "at"])
    of = {int(k): (g["at"].tolist(), g["val"].tolist()) for k, g in p.groupby("edge_id")}
    return Graph(tail, head, edge, None, [of.get(int(e)) for e in edge])


def eval_points(points: tuple[list[int], list[int]], t: int, period: int) -> int:
    """Integer evaluation of a travel-time function, as functions.ttf.eval_ms does it."""
    at, val = points
    if len(at) <= 2:
        return val[0]
    x = t % period
    k = bisect_right(at, x) - 1
    if at[k] == x or k + 1 == len(at):
        return val[k]
    rise = at[k + 1] + val[k + 1] - at[k] - val[k]
    return at[k] + val[k] + (x - at[k]) * rise // (at[k + 1] - at[k]) - x


def spread(queries: DataFrame) -> DataFrame:
    """``queries`` in enough partitions for all cores: a small file's rows are long work for one task.
    Queries of one target are neighbours, as they share what is found for it."""
    n = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), queries.sparkSession.sparkContext.defaultParallelism)
    apart = queries.repartition(n, *queries.columns)
    return apart.sortWithinPartitions("target") if "target" in queries.columns else apart


def path_times(paths: DataFrame, functions: DataFrame, period: int = 86_400_000) -> DataFrame:
    """``paths`` (q, path of edges, departure) as q, tt and arrival, in tasks that hold ``functions``
    (edge_id, f), of which the caller has checked that they are few."""
    rows = functions.select("edge_id", "f.at", "f.val").collect()
    shared = paths.sparkSession.sparkContext.broadcast({r[0]: (list(r[1]), list(r[2])) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            start, out = b.column("departure").to_pylist(), []
            for path, t in zip(b.column("path").to_pylist(), start, strict=True):
                for e in path:
                    t += eval_points(of[e], t, period)
                out.append(t)
            arrival, departure = np.array(out, np.int64), np.array(start, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("q"), pa.array(arrival - departure), pa.array(arrival)], names=["q", "tt", "arrival"])

    return paths.select(F.col("q").cast("bigint").alias("q"), "path", F.col("departure").cast("bigint").alias("departure")).mapInArrow(run, "q bigint, tt bigint, arrival bigint")


RESULT = "dist bigint, node_path array<bigint>, edge_path array<bigint>"


def _route(shared, cost_of: Callable, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            out: list[list] = [[], [], []]
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                source, target, start = row[0], row[1], row[2] if len(row) > 2 else 0
                labels, parent, _ = g.search(source, target, cost_of(g), start)
                end = labels.get(g.number.get(target, -1))
                nodes, path = g.path(parent, source, target) if end is not None else (None, None)
                for column, v in zip(out, (None if end is None else int(end - start), nodes, path), strict=True):
                    column.append(v)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), *arrays], names=[*b.schema.names, "dist", "node_path", "edge_path"])

    return run


def _static(g: Graph):
    return lambda k, _: g.weight[k]


def _timed(period: int):
    def of(g: Graph):
        return lambda k, t: None if g.points[k] is None else eval_points(g.points[k], t, period)

    return of


def dijkstra(queries: DataFrame, graph: Graph) -> DataFrame:
    """``queries`` (source, target, ...) with dist, node_path, edge_path; null where unreachable."""
    return _run(queries, graph, _static, ["source", "target"])


def td_dijkstra(queries: DataFrame, graph: Graph, period: int = 86_400_000) -> DataFrame:
    """As ``dijkstra``, for ``departure`` in ms on a graph with travel-time functions."""
    return _run(queries, graph, _timed(period), ["source", "target", "departure"])


def _run(queries: DataFrame, graph: Graph, cost_of: Callable, columns: list[str]) -> DataFrame:
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(graph)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return spread(queries).mapInArrow(_route(shared, cost_of, columns), f"{schema}, {RESULT}")


def hub_labels(dist_from: DataFrame, dist_to: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward (node, hub, d) and backward labels over chosen hubs, from distance tables."""
    out = dist_from.join(hubs, dist_from["node"] == hubs["hub"]).select(F.col("source").alias("node"), "hub", F.col("dist").alias("d"))
    into = dist_to.join(hubs, dist_to["source"] == hubs["hub"]).select("node", "hub", F.col("dist").alias("d"))
    return out, into


def label_distances(queries: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """source, target, dist, hub: the least sum of two labels over a common hub.

    Two equi-joins and a ``min``; AQE splits hot hubs, and nothing but labels of the asked
    nodes is shuffled.
    """
    f = queries.join(out, queries["source"] == out["node"]).select("source", "target", "hub", F.col("d").alias("d1"))
    b = into.select(F.col("node").alias("t_node"), F.col("hub").alias("t_hub"), F.col("d").alias("d2"))
    both = f.join(b, (f["target"] == b["t_node"]) & (f["hub"] == b["t_hub"]))
    total = F.col("d1") + F.col("d2")
    return both.groupBy("source", "target").agg(F.min(total).alias("dist"), F.min_by("hub", F.struct(total, F.col("hub"))).alias("hub"))


def many_to_many(sources: DataFrame, targets: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """Bucket join: all sources against all targets through common hubs."""
    f = sources.join(out, sources["source"] == out["node"]).select("source", "hub", F.col("d").alias("d1"))
    b = targets.join(into, targets["target"] == into["node"]).select("target", "hub", F.col("d").alias("d2"))
    return f.join(b, "hub").groupBy("source", "target").agg(F.min(F.col("d1") + F.col("d2")).alias("dist"))


def nearest(dist: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """source, node, dist, rank: the k nearest targets of each source, ties by node."""
    near = dist.join(targets, dist["node"] == targets["target"], "left_semi")
    w = Window.partitionBy("source").orderBy("dist", "node")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def settled_ranks(dist: DataFrame) -> DataFrame:
    """The 2^k-th node that a search from each source settles: source, k, node, dist."""
    w = Window.partitionBy("source").orderBy("dist", "node")
    r = dist.withColumn("r", F.row_number().over(w))
    return r.where(F.bit_count("r") == 1).select("source", F.log2("r").cast("int").alias("k"), "node", "dist")


def first_beyond(dist: DataFrame, limit: int) -> DataFrame:
    """The first node settled beyond ``limit`` from each source."""
    return dist.where(F.col("dist") > limit).groupBy("source").agg(F.min_by("node", F.struct("dist", "node")).alias("node"), F.min("dist").alias("dist"))


def landmark_bounds(queries: DataFrame, from_landmark: DataFrame, to_landmark: DataFrame) -> DataFrame:
    """Lower bounds by the triangle inequality: the best of d(l,t)-d(l,s) and d(s,l)-d(t,l)."""
    a = from_landmark.select(F.col("source").alias("l"), F.col("node").alias("n"), F.col("dist").alias("d"))
    b = to_landmark.select(F.col("source").alias("l"), F.col("node").alias("n"), F.col("dist").alias("d"))

    def pair(x: DataFrame) -> DataFrame:
        s, t = x.select("l", F.col("n").alias("source"), F.col("d").alias("ds")), x.select(F.col("l").alias("l2"), F.col("n").alias("target"), F.col("d").alias("dt"))
        return queries.join(s, "source").join(t.withColumnRenamed("l2", "l"), ["l", "target"])

    up = pair(a).select("source", "target", (F.col("dt") - F.col("ds")).alias("bound"))
    down = pair(b).select("source", "target", (F.col("ds") - F.col("dt")).alias("bound"))
    return up.unionByName(down).groupBy("source", "target").agg(F.greatest(F.max("bound"), F.lit(0)).alias("bound"))


def triangles(up: DataFrame) -> DataFrame:
    """Lower triangles of a graph ordered by rank: a->b over a node m of lower rank than both."""
    return (
        up.alias("x")
        .join(up.alias("y"), F.col("x.low") == F.col("y.low"))
        .where("x.high < y.high")
        .join(up.alias("z"), (F.col("z.low") == F.col("x.high")) & (F.col("z.high") == F.col("y.high")))
        .select(F.col("x.low").alias("m"), F.col("x.high").alias("a"), F.col("y.high").alias("b"), F.col("x.weight").alias("w_ma"), F.col("y.weight").alias("w_mb"), F.col("z.weight").alias("w_ab"))
    )


def pareto(labels: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Labels of two criteria that no other label of the same key dominates."""
    w = Window.partitionBy(*by).orderBy(first, second).rowsBetween(Window.unboundedPreceding, -1)
    before: Column = F.min(second).over(w)
    return labels.distinct().withColumn("_least", before).where(F.col("_least").isNull() | (F.col(second) < F.col("_least"))).drop("_least")
