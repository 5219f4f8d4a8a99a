"""Contraction by joins, pruned metrics and goal-directed searches against plain searches."""

import numpy as np
import pytest
import pyspark.sql.functions as F
from tests_support import distances, random_graph

from routeloom.operators import assignment, contraction, hierarchy, potentials, search, workloads


def edges_of(g):
    tail = [u for u in range(len(g.nodes)) for _ in range(g.first[u], g.first[u + 1])]
    return [(g.edge[k], int(g.nodes[tail[k]]), int(g.nodes[g.head[k]]), g.weight[k]) for k in range(len(tail))]


def metric_of(g):
    return hierarchy.Hierarchy(g, hierarchy.min_degree_order(g)).customize()


@pytest.mark.parametrize("core", [0, 6])
def test_contraction(spark, core):
    g = random_graph(3, 16, 40)
    e = spark.createDataFrame(edges_of(g), "edge_id int, tail int, head int, weight long")
    arcs, rest = contraction.contract(e.unionByName(e.limit(1).withColumn("head", F.col("tail"))), core)
    nodes = spark.createDataFrame([(int(n),) for n in g.nodes], "node int")
    out, into = (contraction.labels(nodes, arcs, rest, f) for f in (True, False))
    got = {(r.source, r.target): r.dist for r in search.many_to_many(nodes.withColumnRenamed("node", "source"), nodes.withColumnRenamed("node", "target"), out, into).collect()}
    assert got == {(int(s), v): d for s in g.nodes for v, d in distances(g, int(s)).items()}
    near = contraction.label_nearest(nodes.withColumnRenamed("node", "source"), nodes.withColumnRenamed("node", "target"), out, into, 3).collect()
    for s in map(int, g.nodes):
        want = sorted((d, v) for v, d in distances(g, s).items())[:3]
        assert sorted((r.dist, r.node) for r in near if r.source == s) == want


def test_pruned_metric():
    for seed in range(5):
        g = random_graph(seed)
        full = hierarchy.Hierarchy(g, hierarchy.min_degree_order(g)).customize(perfect=True)
        small = full.pruned()
        assert all(small.distance(int(s), int(t)) == full.distance(int(s), int(t)) == distances(g, int(s)).get(int(t)) for s in g.nodes for t in g.nodes)
        assert len([1 for x in small.out for _ in x]) <= len([1 for x in full.out for _ in x])


def test_potentials_are_exact_and_guide():
    for seed in range(5):
        g = random_graph(seed)
        m = metric_of(g)
        for t in map(int, g.nodes):
            to, many = potentials.Potential(m, [t]), potentials.Potential(m, [t, int(g.nodes[0])])
            for s in map(int, g.nodes):
                d = distances(g, s)
                assert to(s) == d.get(t, float("inf")) and many(s) == min(d.get(t, float("inf")), d.get(int(g.nodes[0]), float("inf")))
                slow = [w * (1 + k % 3) for k, w in enumerate(g.weight)]
                labels, _, order = g.search(s, t, lambda k, _, slow=slow: slow[k])
                found, settled = potentials.guided(g, s, t, to, lambda k, _, slow=slow: slow[k])
                assert found == labels.get(g.number[t]) and settled <= max(1, len(order))
    assert potentials.guided(g, -1, -2, lambda n: 0.0, lambda k, _: 1) == (None, 0)


def test_minimum_degree_order_is_near_linear():
    n = 20_000
    t = np.arange(n - 1)
    g = search.Graph(t, t + 1, t, np.ones(n - 1, np.int64))
    assert sorted(hierarchy.min_degree_order(g)) == list(range(n))


def test_unfinished_distances_raise(spark):
    e = spark.createDataFrame([(k, k + 1, 1) for k in range(6)], "tail int, head int, weight long")
    with pytest.raises(RuntimeError, match="rounds"):
        search.relax(e, spark.createDataFrame([(0,)], "source int"), max_rounds=2)


def test_two_stage_step(spark):
    """Costs are those on the simulated weights, no route comes twice, and probabilities sum to 1."""
    g = random_graph(1)
    weights = spark.createDataFrame(edges_of(g), "edge_id int, tail int, head int, weight long")
    w = {e: x for e, _, _, x in edges_of(g)}
    trips = spark.createDataFrame([(i, int(g.nodes[i % 14]), int(g.nodes[(i * 5 + 1) % 14])) for i in range(40)], "query_id long, source long, target long")
    from routeloom.plans.graph_queries import _adjust, _along, _route

    alternatives, chosen, gap = assignment.two_stage_step(trips, weights, None, _route, _adjust, _along)
    rows = alternatives.collect()
    assert rows and all(r.cost == sum(w[e] for e in r.path) for r in rows)
    for q in {r.query_id for r in rows}:
        mine = [r for r in rows if r.query_id == q]
        assert sum(r.prob for r in mine) == pytest.approx(1) and len({tuple(r.path) for r in mine}) == len(mine)
    best = {r.query_id: min(x.cost for x in rows if x.query_id == r.query_id) for r in rows}
    want = sum(max(0, r.cost - best[r.query_id]) if abs(r.cost - best[r.query_id]) >= 1 else 0 for r in chosen.collect()) / sum(best.values())
    assert gap == pytest.approx(want)
    two, _, gaps = assignment.two_stage(trips, weights, 2, _route, _adjust, _along)
    assert len(gaps) == 2 and two.count() >= len(best)


def test_search_spaces(spark):
    g = random_graph(2)
    dist = spark.createDataFrame([(int(s), v, d) for s in g.nodes for v, d in distances(g, int(s)).items()], "source long, node long, dist long")
    q = spark.createDataFrame([(int(g.nodes[0]), int(t)) for t in g.nodes], "source long, target long")
    for r in workloads.search_spaces(q, dist).collect():
        _, _, order = g.search(r.source, r.target, lambda k, _: g.weight[k])
        assert r.settled == len(order)
