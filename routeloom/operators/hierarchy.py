"""Customizable hierarchies: chordal fill in an order, customization by triangles, tree queries.

The topology is prepared once on the driver (its size is checked by ``load_graph``); weights
are customized in numpy; queries run as tasks over the broadcast hierarchy, or as joins of
ancestors (``ancestor_labels``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators.search import Graph, spread

INF = float("inf")


def min_degree_order(graph: Graph) -> list[int]:
    """Nodes by the least current degree while their neighbours are joined; any order is right."""
    n = len(graph.nodes)
    near: list[set[int]] = [set() for _ in range(n)]
    for u in range(n):
        for k in range(graph.first[u], graph.first[u + 1]):
            v = graph.head[k]
            if u != v:
                near[u].add(v)
                near[v].add(u)
    # A heap of (degree, node), entries of old degrees passed over: near-linear for sparse graphs.
    heap, done, order = [(len(near[u]), u) for u in range(n)], [False] * n, []
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if done[u] or d != len(near[u]):
            continue
        done[u] = True
        order.append(u)
        for v in near[u]:
            near[v] |= near[u]
            near[v] -= {u, v}
            heapq.heappush(heap, (len(near[v]), v))
    return order


def geometric_order(lat: np.ndarray, lon: np.ndarray, near: list[set[int]]) -> list[int]:
    """Nested dissection: cells are halved across their wider side; the nodes beside the cut,
    which separate the halves, come last."""
    out: list[int] = []
    stack: list[tuple[str, list[int]]] = [("cell", list(range(len(lat))))]
    while stack:
        kind, cell = stack.pop()
        if kind == "done" or len(cell) <= 3:
            out.extend(cell)
            continue
        wide = np.ptp(lon[cell]) >= np.ptp(lat[cell])
        side = sorted(cell, key=lambda x: ((lon if wide else lat)[x], x))
        a, b = set(side[: len(side) // 2]), set(side[len(side) // 2 :])
        cut = sorted(x for x in a if near[x] & b)
        # What is pushed last is taken first: the halves, then the separator.
        stack += [("done", cut), ("cell", sorted(b)), ("cell", sorted(a - set(cut)))]
        if not cut and not b:
            break
    return out


class Hierarchy:
    """A chordal supergraph of a graph in an order of its nodes.

    Edges run from lower to higher rank with a weight for either direction; ``parent`` is the
    elimination tree: a node's lowest higher neighbour.
    """

    def __init__(self, graph: Graph, order: list[int]) -> None:
        self.graph, n = graph, len(order)
        self.rank = [0] * n
        for r, u in enumerate(order):
            self.rank[u] = r
        up: list[set[int]] = [set() for _ in range(n)]
        for u in range(n):
            for k in range(graph.first[u], graph.first[u + 1]):
                a, b = sorted((self.rank[u], self.rank[graph.head[k]]))
                if a != b:
                    up[a].add(b)
        self.parent = [-1] * n
        for r in range(n):
            if up[r]:
                p = min(up[r])
                self.parent[r] = p
                up[p] |= up[r] - {p}
        self.up = [sorted(x) for x in up]

    def customize(self, weight: list[float] | None = None, perfect: bool = False) -> "Metric":
        """Weights of all edges: the least over their original ones, then over lower triangles."""
        weight = self.graph.weight if weight is None else weight
        out: list[dict[int, float]] = [{b: INF for b in x} for x in self.up]
        into: list[dict[int, float]] = [{b: INF for b in x} for x in self.up]
        for u in range(len(self.rank)):
            for k in range(self.graph.first[u], self.graph.first[u + 1]):
                a, b = self.rank[u], self.rank[self.graph.head[k]]
                if a < b:
                    out[a][b] = min(out[a][b], weight[k])
                elif b < a:
                    into[b][a] = min(into[b][a], weight[k])
        for m in range(len(self.up)):
            higher = self.up[m]
            for i, a in enumerate(higher):
                for b in higher[i + 1 :]:
                    out[a][b] = min(out[a][b], into[m][a] + out[m][b])
                    into[a][b] = min(into[a][b], into[m][b] + out[m][a])
        if perfect:  # from above: an edge is replaced where the way over a higher node is shorter
            for m in reversed(range(len(self.up))):
                higher = self.up[m]
                for i, a in enumerate(higher):
                    for b in higher[i + 1 :]:
                        out[m][a] = min(out[m][a], out[m][b] + into[a][b])
                        into[m][a] = min(into[m][a], into[m][b] + out[a][b])
                        out[m][b] = min(out[m][b], out[m][a] + out[a][b])
                        into[m][b] = min(into[m][b], into[m][a] + into[a][b])
        return Metric(self, out, into)


class Metric:
    def __init__(self, hierarchy: Hierarchy, out: list[dict[int, float]], into: list[dict[int, float]]) -> None:
        self.h, self.out, self.into = hierarchy, out, into

    def _climb(self, r: int, edges: list[dict[int, float]]) -> dict[int, float]:
        """Distances to all ancestors in the elimination tree, which hold every way up."""
        best = {r: 0.0}
        while r >= 0:
            d = best.get(r, INF)
            if d < INF:
                for b, w in edges[r].items():
                    if d + w < best.get(b, INF):
                        best[b] = d + w
            r = self.h.parent[r]
        return best

    def labels(self, node: int, forward: bool = True) -> dict[int, float]:
        k = self.h.graph.number.get(node)
        return {} if k is None else self._climb(self.h.rank[k], self.out if forward else self.into)

    def distance(self, source: int, target: int) -> float | None:
        a, b = self.labels(source), self.labels(target, False)
        d = min((x + b[m] for m, x in a.items() if m in b), default=INF)
        return None if d == INF else d

    def pruned(self) -> "Metric":
        """Without edges that are infinite, or longer than a way over another edge up and one
        across; after a perfect customization the rest has all distances."""
        keep_out: list[dict[int, float]] = []
        keep_in: list[dict[int, float]] = []
        for m, higher in enumerate(self.h.up):
            out, into = dict(self.out[m]), dict(self.into[m])
            for a in higher:
                for b in higher:
                    if a == b:
                        continue
                    lo, hi = min(a, b), max(a, b)
                    across = self.out[lo].get(hi, INF) if a < b else self.into[lo].get(hi, INF)
                    back = self.into[lo].get(hi, INF) if a < b else self.out[lo].get(hi, INF)
                    # Over a to b, and from b over a: shorter than the edge itself by a positive amount.
                    if self.out[m][a] + across < self.out[m][b]:
                        out.pop(b, None)
                    if self.into[m][a] + back < self.into[m][b]:
                        into.pop(b, None)
            keep_out.append({b: w for b, w in out.items() if w < INF})
            keep_in.append({b: w for b, w in into.items() if w < INF})
        return Metric(self.h, keep_out, keep_in)

    def shortcuts(self) -> list[tuple[int, int, float, float]]:
        return [(a, b, self.out[a][b], self.into[a][b]) for a in range(len(self.out)) for b in self.out[a]]


def tree_distances(queries: DataFrame, metric: Metric) -> DataFrame:
    """``queries`` (source, target, ...) with dist, by walks up the elimination tree."""
    shared = queries.sparkSession.sparkContext.broadcast(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            d = [m.distance(s, t) for s, t in zip(b.column("source").to_pylist(), b.column("target").to_pylist(), strict=True)]
            values = pa.array([None if x is None else int(x) for x in d], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), values], names=[*b.schema.names, "dist"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return spread(queries).mapInArrow(run, f"{schema}, dist bigint")


def ancestor_labels(nodes: DataFrame, metric: Metric, forward: bool) -> DataFrame:
    """(node, hub, d): each node's ancestors as hub labels, for ``search.label_distances``.

    A label has at most the tree's height; pruning those that a shorter way beats keeps the
    answers, so that the perfect metric's labels are the small ones.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = [(n, hub, int(d)) for n in b.column("node").to_pylist() for hub, d in m.labels(n, forward).items() if d < INF]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "hub", "d"])

    return nodes.select(F.col("node").cast("bigint").alias("node")).mapInArrow(run, "node bigint, hub bigint, d bigint")


def merge_metrics(metrics: list[np.ndarray], target: int) -> list[tuple[list[int], np.ndarray]]:
    """Metrics merged greedily, always the two that differ least in sum, to their minimum."""
    groups = [([i], np.asarray(m, float)) for i, m in enumerate(metrics)]
    while len(groups) > max(1, target):
        pairs = [(float(np.abs(groups[i][1] - groups[j][1]).sum()), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        _, i, j = min(pairs)
        (a, x), (b, y) = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [(a + b, np.minimum(x, y))]
    return groups
