"""Goal-directed searches: lower bounds from a hierarchy, and the servers that use them.

A hierarchy of base weights gives exact distances to a target, found on demand. They stay lower
bounds for any weights that are nowhere below the base: scaled, live, blocked or time-dependent
ones, and for graphs with turns. All answers are those of the plain search.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from routeloom.operators.hierarchy import INF, Metric
from routeloom.operators.search import Graph, eval_points, spread


class Potential:
    """Distances to the nearest of some targets, each found once, when it is first asked for."""

    def __init__(self, metric: Metric, targets: list[int]) -> None:
        self.metric, self.found = metric, {}
        self.down: dict[int, float] = {}
        for t in targets:
            for rank, d in metric.labels(t, forward=False).items():
                if d < self.down.get(rank, INF):
                    self.down[rank] = d

    def __call__(self, node: int) -> float:
        place = self.metric.h.graph.number.get(node)
        if place is None:
            return INF
        stack, found, out = [self.metric.h.rank[place]], self.found, self.metric.out
        while stack:
            r = stack[-1]
            if r in found:
                stack.pop()
                continue
            missing = [b for b in out[r] if b not in found]
            if missing:
                stack += missing
                continue
            found[r] = min([self.down.get(r, INF), *(w + found[b] for b, w in out[r].items())])
            stack.pop()
        return found[self.metric.h.rank[place]]


def guided(graph: Graph, source: int, target: int, bound: Callable[[int], float], cost: Callable[[int, float], float | None], start: float = 0) -> tuple[float | None, int]:
    """Arrival at the target minus ``start``, and the nodes settled, by a search in the order of
    arrival plus ``bound``; a node that can't reach the target is never queued."""
    s, t = graph.number.get(source), graph.number.get(target)
    if source == target:
        return 0.0, 1
    if s is None or t is None or bound(source) == INF:
        return None, 0
    best, done, queue = {s: start}, set(), [(start + bound(source), s)]
    while queue:
        _, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        if u == t:
            return best[u] - start, len(done)
        for k in range(graph.first[u], graph.first[u + 1]):
            c = cost(k, best[u])
            if c is None:
                continue
            v, new = graph.head[k], best[u] + c
            if new < best.get(v, INF):
                b = bound(int(graph.nodes[v]))
                if b < INF:
                    best[v] = new
                    heapq.heappush(queue, (new + b, v))
    return None, len(done)


def answered(queries: DataFrame, shared: object, answer: Callable[[object], Callable[..., tuple[float | None, int]]], columns: tuple[str, ...] = ("source", "target"), kind: str = "bigint") -> DataFrame:
    """``queries`` with dist and settled, by ``answer(shared)(*columns)`` in tasks that hold
    ``shared``, whose size its maker has checked."""
    held = queries.sparkSession.sparkContext.broadcast(shared)
    arrow, cast = (pa.int64(), int) if kind == "bigint" else (pa.float64(), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = answer(held.value)
        for b in batches:
            found = [ask(*row) for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            dist = pa.array([None if d is None else cast(d) for d, _ in found], arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), dist, pa.array([n for _, n in found], pa.int64())], names=[*b.schema.names, "dist", "settled"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return spread(queries).mapInArrow(run, f"{schema}, dist {kind}, settled bigint")


def with_potentials(queries: DataFrame, graph: Graph, metric: Metric, period: int = 86_400_000) -> DataFrame:
    """Queries on ``graph`` guided by ``metric``, whose weights are lower bounds of its own. A graph
    with functions is searched from ``departure``. Queries of one target share its potential."""

    def answer(shared):
        g, m = shared
        cost = (lambda k, _: g.weight[k]) if g.points is None else (lambda k, t: None if g.points[k] is None else eval_points(g.points[k], t, period))
        last: list = [None, None]

        def ask(source: int, target: int, departure: int = 0) -> tuple[float | None, int]:
            if last[0] != target:
                last[:] = [target, Potential(m, [target])]
            return guided(g, source, target, last[1], cost, departure)

        return ask

    columns = ("source", "target") if graph.points is None else ("source", "target", "departure")
    return answered(queries, (graph, metric), answer, columns)


def with_turns(queries: DataFrame, turns: Graph, metric: Metric, ends: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Queries between edges (source, target) on the graph of turns, guided by the node hierarchy.

    ``ends`` has each edge's tail, head and base weight: from an edge on, the way to another costs
    at least its own weight and the distance from its head to the other's tail.
    """

    def answer(shared):
        g, m, of = shared

        def ask(source: int, target: int) -> tuple[float | None, int]:
            if target not in of:
                return None, 0
            to = Potential(m, [of[target][0]])
            return guided(g, source, target, lambda e: 0.0 if e == target else of[e][2] + to(of[e][1]), lambda k, _: g.weight[k])

        return ask

    return answered(queries, (turns, metric, ends), answer)


def nearest_of_many(nodes: DataFrame, metric: Metric, targets: list[int]) -> DataFrame:
    """Each node's distance to the nearest of many targets: one bucket of labels for all of them."""

    def answer(shared):
        to = Potential(*shared)
        return lambda node: ((d, 0) if (d := to(node)) < INF else (None, 0))

    return answered(nodes, (metric, targets), answer, ("node",)).drop("settled")


def td_with_ranks(queries: DataFrame, graph: Graph, period: float) -> DataFrame:
    """Time-dependent queries in seconds (departure): dist, and as ``settled`` the target's place in
    the order in which the search settles nodes.

    Arrivals are t + v + (x - a) * (u - v) / (b - a), added in this order: near ties between nodes are
    decided by the last bits, and SQL of the same formula has the same ones."""

    def arrival(points: tuple[list[float], list[float]], t: float) -> float:
        at, val = points
        x = t % period
        k = bisect_right(at, x) - 1
        if k < 0 or k + 1 == len(at):
            return t + val[max(k, 0)]
        return t + val[k] + (x - at[k]) * (val[k + 1] - val[k]) / (at[k + 1] - at[k])

    def answer(g):
        def ask(source: int, target: int, departure: float) -> tuple[float | None, int]:
            s, end = g.number.get(source), g.number.get(target, -1)
            if s is None:
                return None, 0
            best, done, queue = {s: departure}, set(), [(departure, s)]
            while queue:
                t, u = heapq.heappop(queue)
                if u in done:
                    continue
                done.add(u)
                if u == end:
                    return t - departure, len(done)
                for k in range(g.first[u], g.first[u + 1]):
                    if g.points[k] is not None:
                        v, new = g.head[k], arrival(g.points[k], t)
                        if new < best.get(v, INF):
                            best[v] = new
                            heapq.heappush(queue, (new, v))
            return None, 0

        return ask

    return answered(queries, graph, answer, ("source", "target", "departure"), "double")
