"""Query sets, verified runs, guided searches, components, live data and sampled assignment."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.functions import chance, ttf
from routeloom.operators import assignment, search
from routeloom.operators.search import Graph
from routeloom.operators.tables import written


# --- query sets -----------------------------------------------------------------------------


def uniform_queries(spark: SparkSession, nodes: int, n: int, seed: int, period: int | None = None) -> DataFrame:
    """n queries between nodes drawn at random, with departures in the period if it is given."""
    u = lambda k, top: chance.drawn("query_id", seed, k) % top
    q = spark.range(n).select(F.col("id").alias("query_id")).select("query_id", u(0, nodes).alias("source"), u(1, nodes).alias("target"))
    return q if period is None else q.withColumn("departure", u(2, period))


def rank_queries(dist: DataFrame) -> DataFrame:
    """source, target, rank: targets at every power of two of the settling order."""
    return search.settled_ranks(dist).select("source", F.col("node").alias("target"), F.col("k").alias("rank"))


def far_queries(dist: DataFrame, limit: int) -> DataFrame:
    """source, target: the first node settled beyond a limit, such as an hour."""
    return search.first_beyond(dist, limit).select("source", F.col("node").alias("target"))


def ball_queries(dist: DataFrame, size: int, picked: int, seed: int) -> DataFrame:
    """For each source, ``picked`` of the ``size`` nearest nodes, chosen by a hash."""
    w = Window.partitionBy("source")
    ball = dist.withColumn("k", F.row_number().over(w.orderBy("dist", "node"))).where(F.col("k") <= size)
    ball = ball.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("source", "node", F.lit(seed)))))
    return ball.where(F.col("r") <= picked).select("source", F.col("node").alias("target"))


def disagreements(results: DataFrame, truth: DataFrame, on: list[str], value: str = "dist") -> DataFrame:
    """Rows where two runs differ, unreachable included; an empty result verifies the run."""
    t = truth.select(*on, F.col(value).alias("truth"))
    return results.join(t, on).where(~F.col(value).eqNullSafe(F.col("truth"))).select(*on, value, "truth")


# --- components and guided searches ---------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, component of the undirected graph, by least labels and pointer jumping on tables.

    Queries between components are answered without a search.
    """
    both = written(edges.select(F.col("tail").alias("a"), F.col("head").alias("b")).union(edges.select("head", "tail")).distinct(), "both")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = written(label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "step")
        root = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(step.join(root, "component").select("node", "old", F.col("root").alias("component")), "label")
        label = new.select("node", "component")
        if not new.where("old <> component").limit(1).count():
            return label


def connected_only(queries: DataFrame, label: DataFrame) -> DataFrame:
    """Queries whose ends are in one component."""
    a = label.select(F.col("node").alias("source"), F.col("component").alias("ca"))
    b = label.select(F.col("node").alias("target"), F.col("component").alias("cb"))
    return queries.join(a, "source").join(b, "target").where("ca = cb").drop("ca", "cb")


def reversed_graph(graph: Graph) -> Graph:
    tail = [u for u in range(len(graph.nodes)) for _ in range(graph.first[u], graph.first[u + 1])]
    return Graph(graph.nodes[np.array(graph.head)], graph.nodes[np.array(tail)], np.array(graph.edge), np.array(graph.weight))


def a_star(graph: Graph, source: int, target: int, bound: Callable[[int], float]) -> tuple[float | None, int]:
    """Distance and number of settled nodes, guided by a consistent lower bound to the target."""
    s, t = graph.number.get(source), graph.number.get(target)
    if s is None or t is None:
        return None, 0
    best, done, queue = {s: 0.0}, set(), [(bound(source), s)]
    while queue:
        _, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        if u == t:
            return best[u], len(done)
        for k in range(graph.first[u], graph.first[u + 1]):
            v, d = graph.head[k], best[u] + graph.weight[k]
            b = bound(int(graph.nodes[v]))
            if d < best.get(v, math.inf) and b < math.inf:
                best[v] = d
                heapq.heappush(queue, (d + b, v))
    return None, len(done)


def search_spaces(queries: DataFrame, dist: DataFrame) -> DataFrame:
    """source, target, settled, radius: the nodes that a search settles up to the target, from
    distances of the queries' sources; ties by node."""
    to = dist.select(F.col("source").alias("s"), F.col("node").alias("target"), F.struct(F.col("dist").alias("d"), F.col("node").alias("v")).alias("end"))
    q = queries.join(to, (F.col("s") == F.col("source")) & (queries["target"] == to["target"])).select("source", queries["target"], "end")
    n = dist.select(F.col("source").alias("s"), "dist", F.struct(F.col("dist").alias("d"), F.col("node").alias("v")).alias("at"))
    inside = q.join(n, q["source"] == n["s"]).where("at <= end")
    return inside.groupBy("source", "target").agg(F.count(F.lit(1)).alias("settled"), F.max("dist").alias("radius"))


def alternative_pairs(alternatives: DataFrame) -> DataFrame:
    """query_id, first, second and how many distinct edges the two share, for all pairs of a trip's
    few alternatives (query_id, alt_ix, path)."""
    a = alternatives.select("query_id", F.col("alt_ix").alias("first"), F.col("path").alias("p1"))
    b = alternatives.select("query_id", F.col("alt_ix").alias("second"), F.col("path").alias("p2"))
    both = a.join(b, "query_id").where("first < second")
    return both.select("query_id", "first", "second", F.size(F.array_intersect("p1", "p2")).alias("shared"))


def exact_bounds(graph: Graph, target: int) -> Callable[[int], float]:
    """Distances to the target by one search backwards; it serves all queries to that target."""
    back = reversed_graph(graph)
    labels, _, _ = back.search(target, None, lambda k, _: back.weight[k])
    to = {int(back.nodes[u]): d for u, d in labels.items()}
    return lambda node: to.get(node, math.inf)


def landmark_tables(graph: Graph, count: int) -> list[tuple[dict[int, float], dict[int, float]]]:
    """Distances from and to landmarks, each new one the farthest from those before."""
    back, out = reversed_graph(graph), []
    mark = int(graph.nodes[0])
    nearest: dict[int, float] = {}
    for _ in range(count):
        f = {int(graph.nodes[u]): d for u, d in graph.search(mark, None, lambda k, _: graph.weight[k])[0].items()}
        b = {int(back.nodes[u]): d for u, d in back.search(mark, None, lambda k, _: back.weight[k])[0].items()}
        out.append((f, b))
        for n in map(int, graph.nodes):
            nearest[n] = min(nearest.get(n, math.inf), f.get(n, math.inf), b.get(n, math.inf))
        mark = max(nearest, key=lambda n: (nearest[n] if nearest[n] < math.inf else -1, -n))
    return out


def landmark_bound(tables: list[tuple[dict[int, float], dict[int, float]]], target: int) -> Callable[[int], float]:
    def bound(node: int) -> float:
        best = 0.0
        for f, b in tables:
            if node in f and target in f:
                best = max(best, f[target] - f[node])
            if node in b and target in b:
                best = max(best, b[node] - b[target])
        return best

    return bound


def bidirectional(graph: Graph, back: Graph, source: int, target: int) -> float | None:
    """Distance by searches from both ends; it stops once both queues' least keys sum to the best."""
    if source not in graph.number or target not in graph.number:
        return None
    ends = [(graph, {graph.number[source]: 0.0}, set(), [(0.0, graph.number[source])]), (back, {back.number[target]: 0.0}, set(), [(0.0, back.number[target])])]
    best = 0.0 if source == target else math.inf
    while all(x[3] for x in ends) and ends[0][3][0][0] + ends[1][3][0][0] < best:
        side = 0 if ends[0][3][0][0] <= ends[1][3][0][0] else 1
        g, label, done, queue = ends[side]
        other_graph, other, _, _ = ends[1 - side]
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        for k in range(g.first[u], g.first[u + 1]):
            v, new = g.head[k], d + g.weight[k]
            if new < label.get(v, math.inf):
                label[v] = new
                heapq.heappush(queue, (new, v))
                w = other_graph.number[int(g.nodes[v])]
                best = min(best, new + other.get(w, math.inf))
    return None if best == math.inf else best


# --- live data ------------------------------------------------------------------------------


def live_overlay(edges: DataFrame, live: DataFrame, now: int, period: int) -> tuple[DataFrame, DataFrame]:
    """Edges with live travel time and its end, and counts of what was closed or lasts too long.

    ``live`` has edge_id, live (null: closed) and duration; what lasts a period or longer is no
    live datum but a long-term one.
    """
    short = live.where(F.col("duration") < period).select("edge_id", "live", (F.col("duration") + now).alias("until"))
    counts = live.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("live").isNull()).alias("blocked"), F.count_if(F.col("duration") >= period).alias("long_term"))
    return edges.join(short, "edge_id", "left"), counts


def set_at(functions: DataFrame, updates: DataFrame) -> DataFrame:
    """Functions (edge_id, f) with the value of an existing point (edge_id, at, val) replaced,
    the last value made the first, and nobody overtaking. A point that isn't there raises."""
    u = updates.groupBy("edge_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "val"))).alias("u"))
    j = functions.join(u, "edge_id", "left")
    known = F.transform("f", lambda p: p["at"])
    ok = F.col("u").isNull() | (F.size(F.array_except(F.map_keys("u"), known)) == 0)
    new = F.transform("f", lambda p: F.struct(p["at"].alias("at"), F.coalesce(F.try_element_at(F.col("u"), p["at"]), p["val"]).alias("val")))
    first = lambda f: F.transform(f, lambda p, i: F.struct(p["at"].alias("at"), F.when(i == F.size(f) - 1, f[0]["val"]).otherwise(p["val"]).alias("val")))
    changed = ttf.let(ttf.let(new, first), ttf.fifo)
    checked = F.when(ok, changed).otherwise(F.raise_error(F.lit("no such point")).cast("array<struct<at:bigint,val:bigint>>"))
    return j.select("edge_id", F.when(F.col("u").isNull(), F.col("f")).otherwise(checked).alias("f"))


def patched(f: Column, live: Column, now: Column, until: Column) -> Column:
    """A floating function with a live value from ``now`` to ``until``, as points: live, then the
    line of slope 1 or -1 that leads back to the prediction, then the prediction."""
    predicted = ttf.eval_s(f, until)
    # Falling: arrivals stand still until the prediction is met; rising: as fast as time.
    meet = F.try_element_at(F.filter(f, lambda p: (p["at"] > until) & F.when(predicted < live, p["at"] + p["val"] >= until + live).otherwise(p["val"] - p["at"] <= live - until)), F.lit(1))
    t = F.coalesce(meet["at"], F.element_at(f, -1)["at"])
    back = F.when(predicted < live, live - (t - until)).otherwise(live + (t - until))
    value = F.when(predicted < live, F.greatest(back, ttf.eval_s(f, t))).otherwise(F.least(back, ttf.eval_s(f, t)))
    head = F.array(F.struct(now.alias("at"), live.alias("val")), F.struct(until.alias("at"), live.alias("val")), F.struct(t.alias("at"), value.alias("val")))
    return F.concat(F.filter(f, lambda p: p["at"] < now), head, F.filter(f, lambda p: p["at"] > t))


# --- assignment -----------------------------------------------------------------------------


def sampled_routes(trips: DataFrame, shares: list[float], weights: DataFrame, route: Callable[[DataFrame, DataFrame], DataFrame], update: Callable[[DataFrame, DataFrame], DataFrame], seed: int) -> DataFrame:
    """Routes sample by sample: each sample sees the weights that those before it left."""
    dealt, out = written(assignment.samples(trips, shares, seed), "samples"), None
    for k in range(len(shares)):
        found = written(route(dealt.where(F.col("sample") == k).drop("sample"), weights), "found").withColumn("sample", F.lit(k))
        out = found if out is None else out.unionByName(found)
        weights = written(update(found, weights), "weights")
    return out


def random_trips(nodes: DataFrame, per_interval: dict[int, int], interval: int, seed: int) -> DataFrame:
    """Trips by interval with random ends; departures spread evenly over the interval."""
    spark = nodes.sparkSession
    n = nodes.count()
    plan = spark.createDataFrame(list(per_interval.items()), "k int, trips int")
    t = plan.select("k", "trips", F.explode(F.sequence(F.lit(0), F.col("trips") - 1)).alias("i")).where("trips > 0")
    u = lambda s: chance.drawn("k", "i", seed, s) % n
    return t.select(F.concat_ws("-", "k", "i").alias("id"), u(0).alias("source"), u(1).alias("target"), (F.col("k") * interval + F.col("i") * interval / F.col("trips")).alias("depart"))


def paired_tests(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Paired t statistic, Cohen's d and the signed-rank statistic of a - b by group, with
    two-sided p-values by the normal approximation."""
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("d"))
    w = Window.partitionBy(*by).orderBy(F.abs("d"))
    ranked = d.where("d <> 0").withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, F.abs("d"))) - 1) / 2)
    rank = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"))
    t = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    j = t.join(rank, by, "left")
    z = (F.col("w_plus") - F.col("m") * (F.col("m") + 1) / 4) / F.sqrt(F.col("m") * (F.col("m") + 1) * (2 * F.col("m") + 1) / 24)
    return j.select(*by, "n", "mean", (F.col("mean") / F.col("sd")).alias("cohen_d"), (F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), "w_plus", z.alias("z"), (2 * (1 - _phi(F.abs(z)))).alias("p_rank"))


def _phi(x: Column) -> Column:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    k = 1 / (1 + 0.2316419 * x)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 1 - F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


def window_bounds(functions: DataFrame, windows: list[tuple[int, int]], period: int = 86_400_000) -> DataFrame:
    """Least and greatest travel time of every function in each window: edge_id, k, lo, hi."""
    spark = functions.sparkSession
    w = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(windows)], "k int, a bigint, b bigint")
    j = functions.crossJoin(F.broadcast(w))
    return j.select("edge_id", "k", ttf.lower_bound_in(F.col("f"), F.col("a"), F.col("b"), period).alias("lo"), ttf.upper_bound_in(F.col("f"), F.col("a"), F.col("b"), period).alias("hi"))


def day_windows(hour: int, hours: tuple[int, ...] = (1, 2, 4, 8), first: int = 6, last: int = 22) -> list[tuple[int, int]]:
    """Windows of several lengths that start at every full hour of the day's busy part."""
    return [(h * hour, (h + n) * hour) for n in hours for h in range(first, last) if h + n <= last]


def contract_chains(edges: DataFrame) -> DataFrame:
    """Edges with nodes of one way in and one way out contracted, as tail, head, weight.

    Chains are followed by doubling: an edge into such a node jumps to where the next jump
    leads, so a chain of length n takes log n rounds.
    """
    ins = edges.where("tail <> head").groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    outs = edges.where("tail <> head").groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    inner = written(ins.join(outs, "node").where("i = 1 AND o = 1").select("node"), "inner")
    e = written(edges.where("tail <> head").select("tail", "head", "weight"), "edges")
    for _ in range(64):
        jump = e.join(inner, e["tail"] == inner["node"], "left_semi").select(F.col("tail").alias("m"), F.col("head").alias("h2"), F.col("weight").alias("w2"))
        j = e.join(jump, e["head"] == jump["m"], "left")
        new = written(j.select("tail", F.when(F.col("h2") == F.col("tail"), F.col("head")).otherwise(F.coalesce("h2", "head")).alias("head"), F.when(F.col("h2") == F.col("tail"), F.col("weight")).otherwise(F.col("weight") + F.coalesce("w2", F.lit(0))).alias("weight"), (F.col("m").isNotNull() & (F.col("h2") != F.col("tail"))).alias("moved")), "chains")
        e = new.select("tail", "head", "weight")
        if not new.where("moved").limit(1).count():
            break
    return e.join(inner, e["tail"] == inner["node"], "left_anti")
