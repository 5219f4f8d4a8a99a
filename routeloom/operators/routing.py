"""Route kernels beyond the shortest path: profiles, alternatives, traffic-aware routes, and
following vehicles through changing travel times.

A kernel answers one query on a graph in memory; ``mapInArrow`` spreads queries, which are
independent of each other. The density update is sequential by its definition and says so.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from routeloom.functions import kernels
from routeloom.operators.search import Graph, spread


def profile(graph: Graph, functions: dict[int, kernels.Points], source: int, period: float = kernels.DAY_S) -> dict[int, kernels.Points]:
    """Travel-time functions from a source to every node it reaches, for all departures.

    Label-correcting: a node's function is the minimum over its incoming edges of the tail's
    function linked with the edge's; nodes whose function sank are visited again, those with
    the least lower bound first.
    """
    s = graph.number[source]
    best: dict[int, kernels.Points] = {s: (np.array([0.0]), np.array([0.0]))}
    queue, waiting = [(0.0, s)], {s}
    while queue:
        _, u = heapq.heappop(queue)
        if u not in waiting:
            continue
        waiting.discard(u)
        for k in range(graph.first[u], graph.first[u + 1]):
            f = functions.get(graph.edge[k])
            if f is None:
                continue
            v, way = graph.head[k], kernels.link(best[u], f, period)
            if v == s:
                continue
            if v in best:
                new, _ = kernels.merge(best[v], way, period)
                at = np.union1d(best[v][0], new[0])
                if (kernels.value(best[v], at, period) - kernels.value(new, at, period)).max() <= 1e-6:
                    continue
                way = new
            best[v] = way
            waiting.add(v)
            heapq.heappush(queue, (float(way[1].min()), v))
    return {int(graph.nodes[u]): f for u, f in best.items()}


def shortest(graph: Graph, source: int, target: int, weight: list[float]) -> tuple[float, list[int], list[int]] | None:
    """Distance, nodes and edge places (not ids) of a shortest path; None if there is none."""
    labels, parent, _ = graph.search(source, target, lambda k, _: weight[k] if weight[k] < float("inf") else None)
    t = graph.number.get(target)
    if t not in labels:
        return None
    places, u, s = [], t, graph.number[source]
    while u != s:
        u, k = parent[u]
        places.append(k)
    places.reverse()
    return labels[t], [source, *(int(graph.nodes[graph.head[k]]) for k in places)], places


@dataclass
class Penalties:
    """Weights that grow around the routes found so far, for alternatives by the penalty method."""

    graph: Graph
    base: int  # the best distance
    times: int = 5  # that a node counts

    def __post_init__(self) -> None:
        g = self.graph
        self.weight = list(g.weight)
        self.seen = [0] * len(g.nodes)
        self.tail = [u for u in range(len(g.nodes)) for _ in range(g.first[u], g.first[u + 1])]
        self.into: list[list[int]] = [[] for _ in g.nodes]
        for k, v in enumerate(g.head):
            self.into[v].append(k)

    def raise_around(self, places: list[int]) -> bool:
        """Raises a route's edges by a tenth, and edges that leave or rejoin it by up to a hundredth of
        the best distance, the more the farther along it; false if all its nodes have been counted
        ``times`` times."""
        g, fresh = self.graph, lambda u: self.seen[u] < self.times
        for k in places:
            if fresh(self.tail[k]) or fresh(g.head[k]):
                self.weight[k] = self.weight[k] * 11 // 10
        upto = np.concatenate([[0], np.cumsum([self.weight[k] for k in places])])
        share = [int(self.base // 100 * int(d) // max(1, int(upto[-1]))) for d in upto]
        for i, k in enumerate(places):
            u, v = self.tail[k], g.head[k]
            rejoining = [x for x in self.into[v] if self.tail[x] != u] if fresh(v) else []
            leaving = [x for x in range(g.first[u], g.first[u + 1]) if g.head[x] != v] if fresh(u) else []
            for x in rejoining:
                self.weight[x] += share[i + 1]
            for x in leaving:
                self.weight[x] += share[i]
        nodes = {self.tail[places[0]], *(g.head[k] for k in places)} if places else set()
        counted = [u for u in nodes if fresh(u)]
        for u in counted:
            self.seen[u] += 1
        return bool(counted)


def penalty_alternatives(graph: Graph, source: int, target: int, most: int = 10, stretch: float = 1.25, fresh: float = 0.05) -> list[list[int]]:
    """Edge ids of a shortest path and of alternatives by the penalty method.

    After each route the weights around it grow and the search runs again. A stretch of new edges
    counts if it is longer than ``fresh`` of the best distance and at most ``stretch`` times the way
    between its ends on the routes so far; a route with such a stretch is an alternative. It ends
    with ``most`` stretches, a route that is too long, or when all nodes have been counted enough.
    """
    first = shortest(graph, source, target, graph.weight)
    if first is None:
        return []
    base, _, places = first
    routes, used = [places], set(places)
    penalties, found = Penalties(graph, int(base)), 0
    limit = int(base * stretch * 1.1) + 2 * (int(base) // 100)
    while penalties.raise_around(places):
        again = shortest(graph, source, target, penalties.weight)
        if again is None or again[0] > limit:
            break
        places = again[2]
        good = 0
        for part in _new_stretches(places, used):
            length = sum(graph.weight[k] for k in part)
            if length <= fresh * base:
                continue
            between = _within(graph, used, penalties.tail[part[0]], graph.head[part[-1]])
            if between is None or length <= stretch * between:
                good += 1
                used |= set(part)
        if good:
            routes.append(places)
            found += good
        if sum(graph.weight[k] for k in places) > stretch * base or found >= most:
            break
    return [[graph.edge[k] for k in r] for r in routes]


def _new_stretches(places: list[int], used: set[int]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for k in places:
        if k in used:
            out.append([])
        else:
            out[-1].append(k)
    return [x for x in out if x]


def _within(graph: Graph, used: set[int], a: int, b: int) -> float | None:
    """Distance between two places of nodes over used edges only."""
    labels, _, _ = graph.search(int(graph.nodes[a]), int(graph.nodes[b]), lambda k, _: graph.weight[k] if k in used else None)
    return labels.get(b)


def alternative_quality(graph: Graph, routes: list[list[int]], source: int, target: int) -> dict[str, float]:
    """Total and average distance of the graph that routes make together, and its decision edges."""
    used = sorted({e for r in routes for e in r})
    place = {e: k for k, e in enumerate(graph.edge)}
    tail_of = {k: u for u in range(len(graph.nodes)) for k in range(graph.first[u], graph.first[u + 1])}
    ks = [place[e] for e in used]
    sub = Graph(np.array([graph.nodes[tail_of[k]] for k in ks]), np.array([graph.nodes[graph.head[k]] for k in ks]), np.array(used), np.array([graph.weight[k] for k in ks]))
    back = Graph(np.array([graph.nodes[graph.head[k]] for k in ks]), np.array([graph.nodes[tail_of[k]] for k in ks]), np.array(used), np.array([graph.weight[k] for k in ks]))
    d1 = {int(sub.nodes[u]): d for u, d in sub.search(source, None, lambda k, _: sub.weight[k])[0].items()}
    d2 = {int(back.nodes[u]): d for u, d in back.search(target, None, lambda k, _: back.weight[k])[0].items()}
    base = d1[target]
    total = sum(w / (d1[a] + w + d2[b]) for k, w in zip(ks, (graph.weight[k] for k in ks), strict=True) if (a := int(graph.nodes[tail_of[k]])) in d1 and (b := int(graph.nodes[graph.head[k]])) in d2)
    outs = np.bincount([tail_of[k] for k in ks])
    return {"total": total, "average": sum(graph.weight[k] for k in ks) / (base * total), "decisions": float(sum(n - 1 for n in outs if n > 1))}


def violations(path: list[int], lengths: list[float], smooth: Callable[[int, int], float], epsilon: float) -> list[tuple[int, int]]:
    """Sub-paths (start, end place of nodes) longer than (1 + epsilon) times the smooth optimum.

    A path that comes back to a node has its cycles as the only violations. Else every start
    has its first violating end, and of nested ranges the inner ones stay.
    """
    seen: dict[int, int] = {}
    cycles = []
    for k, u in enumerate(path):
        if u in seen:
            cycles.append((seen[u], k))
        seen[u] = k
    if cycles:
        return cycles
    at = np.concatenate([[0.0], np.cumsum(lengths)])
    found = []
    for i in range(len(path)):
        for j in range(i + 1, len(path)):
            best = smooth(path[i], path[j])
            if at[j] - at[i] - best > np.floor(epsilon * best):
                found.append((i, j))
                break
    inner, least = [], float("inf")
    for i, j in reversed(found):
        if j < least:
            inner.append((i, j))
            least = j
    return inner[::-1]


@dataclass
class TrafficAware:
    """Routes on live weights whose sub-paths stay near the smooth optimum."""

    graph: Graph
    live: list[float]
    epsilon: float = 1.0
    most: int = 200
    _trees: dict[int, dict[int, float]] = field(default_factory=dict)

    def smooth(self, a: int, b: int) -> float:
        if a not in self._trees:
            labels, _, _ = self.graph.search(a, None, lambda k, _: self.graph.weight[k])
            self._trees[a] = {int(self.graph.nodes[u]): d for u, d in labels.items()}
        return self._trees[a].get(b, float("inf"))

    def _bad(self, nodes: list[int], places: list[int]) -> list[tuple[int, int]]:
        return violations(nodes, [self.graph.weight[k] for k in places], self.smooth, self.epsilon)

    def exact(self, source: int, target: int) -> tuple[list[int], bool] | None:
        """The shortest live path without a violating sub-path: edge ids, and whether it is proven.

        Paths are searched best first over (node, state of a matcher of forbidden sub-paths);
        each round forbids what violates, until nothing does or ``most`` rounds are over; then the
        last path is given as not proven.
        """
        forbidden: list[tuple[int, ...]] = []
        for _ in range(self.most):
            found = self._avoiding(source, target, forbidden)
            if found is None:
                return None
            nodes, places = found
            bad = self._bad(nodes, places)
            if not bad:
                return [self.graph.edge[k] for k in places], True
            forbidden += [tuple(places[i:j]) for i, j in bad]
        return [self.graph.edge[k] for k in places], False

    def _avoiding(self, source: int, target: int, forbidden: list[tuple[int, ...]]) -> tuple[list[int], list[int]] | None:
        g = self.graph
        # The matcher's states are the prefixes of forbidden sub-paths.
        prefixes = {p[:k] for p in forbidden for k in range(len(p) + 1)} | {()}
        whole = set(forbidden)

        def step(state: tuple[int, ...], k: int) -> tuple[int, ...] | None:
            seen = (*state, k)
            if any(seen[i:] in whole for i in range(len(seen))):
                return None
            while seen not in prefixes:
                seen = seen[1:]
            return seen

        s, t = g.number.get(source), g.number.get(target)
        if s is None or t is None:
            return None
        start = (s, ())
        best, parent, queue, done, n = {start: 0.0}, {}, [(0.0, 0, start)], set(), 0
        while queue:
            d, _, x = heapq.heappop(queue)
            if x in done:
                continue
            done.add(x)
            u, state = x
            if u == t:
                places = []
                while x != start:
                    x, k = parent[x]
                    places.append(k)
                places.reverse()
                return [source, *(int(g.nodes[g.head[k]]) for k in places)], places
            for k in range(g.first[u], g.first[u + 1]):
                new = step(state, k)
                if new is None or self.live[k] == float("inf"):
                    continue
                y = (g.head[k], new)
                if d + self.live[k] < best.get(y, float("inf")):
                    best[y], parent[y] = d + self.live[k], (x, k)
                    n += 1
                    heapq.heappush(queue, (best[y], n, y))
        return None

    def fixed(self, source: int, target: int) -> tuple[list[int], bool] | None:
        """One live path, its violating stretches replaced by smooth-optimal ones until none is left."""
        found = shortest(self.graph, source, target, self.live)
        if found is None:
            return None
        _, nodes, places = found
        for _ in range(self.most):
            bad = self._bad(nodes, places)
            if not bad:
                return [self.graph.edge[k] for k in places], True
            out, at = [], 0
            for i, j in bad:
                if i < at:
                    continue  # overlaps one that is replaced already
                out += places[at:i]
                if nodes[i] != nodes[j]:
                    out += shortest(self.graph, nodes[i], nodes[j], self.graph.weight)[2]
                at = j
            places = out + places[at:]
            nodes = [source, *(int(self.graph.nodes[self.graph.head[k]]) for k in places)]
        return [self.graph.edge[k] for k in places], False

    def baseline(self, source: int, target: int) -> list[int] | None:
        found = shortest(self.graph, source, target, self.graph.weight)
        return None if found is None else [self.graph.edge[k] for k in found[2]]


def per_query(queries: DataFrame, graph: Graph, answer: Callable[[Graph, int, int], list[list[int]]]) -> DataFrame:
    """query_id, k, edges: the lists that a kernel gives for each query, spread over tasks."""
    shared = queries.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, k, r) for q, s, t in zip(*(b.column(c).to_pylist() for c in ("query_id", "source", "target")), strict=True) for k, r in enumerate(answer(shared.value, s, t))]
            q, k, r = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(k, pa.int32()), pa.array(r, pa.list_(pa.int64()))], names=["query_id", "k", "edges"])

    return spread(queries.select("query_id", "source", "target")).mapInArrow(run, "query_id bigint, k int, edges array<bigint>")


@dataclass
class Follower:
    """Vehicles followed one after the other through travel times that each of them changes.

    ``begins`` are the starts of contiguous intervals, ``end`` the last one's end. Sampled
    seconds give a density, the density a speed, the speed the interval's travel time. The
    order matters, as later vehicles meet earlier updates: this is the exact form of
    ``assignment.frozen_density``, for one driver or one task.
    """

    begins: list[float]
    end: float
    lengths: list[float]
    lanes: list[int]
    speed: Callable[[int, float], float]
    times: list[list[float]]  # travel time by edge and interval
    sampled: dict[tuple[int, int], float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if sorted(self.begins) != self.begins or not self.begins or self.end <= self.begins[-1]:
            raise ValueError("intervals must be contiguous and rise")

    def travel_time(self, edge: int, t: float) -> float:
        """Interpolated between interval starts; constant after the last."""
        v = self.times[edge]
        k = bisect_right(self.begins, t) - 1
        if k < 0 or k + 1 >= len(v):
            return v[max(0, min(k, len(v) - 1))]
        share = (t - self.begins[k]) / (self.begins[k + 1] - self.begins[k])
        return v[k] + share * (v[k + 1] - v[k])

    def move(self, path: list[int], departure: float, sign: float) -> None:
        """Adds (sign 1) or removes (-1) a vehicle's seconds along a path."""
        t = departure
        for edge in path:
            leave = t + self.travel_time(edge, t)
            if not self.begins[0] <= t < self.end:
                return
            k = bisect_right(self.begins, t) - 1
            while k < len(self.begins) and self.begins[k] < leave:
                stop = self.begins[k + 1] if k + 1 < len(self.begins) else self.end
                spent = min(leave, stop) - max(t, self.begins[k])
                if spent > 0:
                    self._update(edge, k, sign * spent, stop - self.begins[k])
                k += 1
            t = min(leave, self.end)

    def _update(self, edge: int, k: int, seconds: float, span: float) -> None:
        s = max(0.0, self.sampled.get((edge, k), 0.0) + seconds)
        self.sampled[edge, k] = s
        density = 1000 * s / (span * self.lengths[edge]) / self.lanes[edge] if self.lengths[edge] else 0.0
        v = self.speed(edge, density) / 3.6
        self.times[edge][k] = 100_000.0 if v < 1e-6 else min(self.lengths[edge] / v, 100_000.0)
        # Nobody overtakes by waiting for the next interval.
        for j in range(len(self.begins) - 2, -1, -1):
            self.times[edge][j] = min(self.times[edge][j], self.begins[j + 1] - self.begins[j] + self.times[edge][j + 1])


def window_union(graph: Graph, functions: dict[int, kernels.Points], source: int, target: int, windows: list[tuple[float, float]]) -> set[int]:
    """Edges on the shortest paths of several windows' mean travel times (windows may wrap)."""
    out: set[int] = set()
    for a, b in windows:
        stop = b if b > a else b + kernels.DAY_S
        t = np.linspace(a, stop, 97)
        mean = [float(np.trapezoid(kernels.value(f, t), t) / (stop - a)) if (f := functions.get(e)) is not None else float("inf") for e in graph.edge]
        found = shortest(graph, source, target, mean)
        if found:
            out |= {graph.edge[k] for k in found[2]}
    return out


def functions_by_edge(graph: Graph, of: Callable[[int], int] = int, period: float = kernels.DAY_S) -> dict[int, kernels.Points]:
    """The graph's travel-time functions in seconds, complete over the period, by edge id."""
    out = {}
    for edge, points in zip(graph.edge, graph.points or [], strict=True):
        if points is not None:
            out[of(edge)] = (np.array(points[0], float) / 1000, np.array(points[1], float) / 1000)
    return out


def profile_rows(sources: DataFrame, graph: Graph, period: float = kernels.DAY_S) -> DataFrame:
    """source, node, lo, hi, points: every profile from each source, its bounds and its size.

    One task holds one source's profiles at a time; sources are independent.
    """
    shared = sources.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        functions = functions_by_edge(g)
        for b in batches:
            for s in b.column("source").to_pylist():
                found = profile(g, functions, s, period) if s in g.number else {}
                rows = [(s, n, float(f[1].min()), float(f[1].max()), len(f[0])) for n, f in found.items() if n != s]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source", "node", "lo", "hi", "points"])

    return sources.select("source").mapInArrow(run, "source bigint, node bigint, lo double, hi double, points int")


#: Windows of a day in seconds whose mean metrics differ: night, morning, noon, evening.
DAY_WINDOWS = ((22 * 3600.0, 5 * 3600.0), (7 * 3600.0, 10 * 3600.0), (11 * 3600.0, 15 * 3600.0), (16 * 3600.0, 19 * 3600.0))


def sampled_windows(queries: DataFrame, graph: Graph, windows: tuple[tuple[float, float], ...] = DAY_WINDOWS) -> DataFrame:
    """query_id, dist: time-dependent search on the union of the windows' shortest paths only.

    An upper bound of the exact travel time, close to it where the windows fit the day.
    """
    from routeloom.operators.search import eval_points

    shared = queries.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        functions = functions_by_edge(g)
        means = []
        for a, b in windows:
            stop = b if b > a else b + kernels.DAY_S
            t = np.linspace(a, stop, 97)
            means.append([float(np.trapezoid(kernels.value(functions[e], t), t) / (stop - a)) if e in functions else float("inf") for e in g.edge])
        for b in batches:
            out = []
            for s, t, start in zip(*(b.column(c).to_pylist() for c in ("source", "target", "departure")), strict=True):
                active = {k for w in means if s in g.number and (found := shortest(g, s, t, w)) for k in found[2]}
                labels, _, _ = g.search(s, t, lambda k, now: eval_points(g.points[k], now, 86_400_000) if k in active else None, start)  # noqa: B023
                end = labels.get(g.number.get(t, -1))
                out.append(None if end is None else int(end - start))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(out, pa.int64())], names=["query_id", "dist"])

    return spread(queries.select("query_id", "source", "target", "departure")).mapInArrow(run, "query_id bigint, dist bigint")
