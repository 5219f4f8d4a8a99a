import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.functions import kernels
from routeloom.operators import hierarchy, routing, search


def random_graph(seed, n=14, m=40, top=30):
    rng = np.random.default_rng(seed)
    t, h = rng.integers(0, n, m), rng.integers(0, n, m)
    return search.Graph(t, h, np.arange(m), rng.integers(1, top, m))


def distances(g, s):
    labels, _, _ = g.search(s, None, lambda k, _: g.weight[k])
    return {int(g.nodes[u]): d for u, d in labels.items()}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.booleans(), st.booleans())
def test_hierarchy_is_dijkstra(seed, perfect, geometric):
    g = random_graph(seed)
    order = hierarchy.min_degree_order(g)
    if geometric:
        rng = np.random.default_rng(seed)
        near = [set() for _ in g.nodes]
        for u in range(len(g.nodes)):
            for k in range(g.first[u], g.first[u + 1]):
                near[u].add(g.head[k])
                near[g.head[k]].add(u)
        order = hierarchy.geometric_order(rng.random(len(g.nodes)), rng.random(len(g.nodes)), near)
    assert sorted(order) == list(range(len(g.nodes)))
    m = hierarchy.Hierarchy(g, order).customize(perfect=perfect)
    for s in map(int, g.nodes):
        want = distances(g, s)
        assert {t: m.distance(s, t) for t in map(int, g.nodes)} == {t: want.get(t) for t in map(int, g.nodes)}


def test_tree_and_label_queries(spark):
    g = random_graph(5)
    m = hierarchy.Hierarchy(g, hierarchy.min_degree_order(g)).customize(perfect=True)
    q = spark.createDataFrame([(s, t) for s in map(int, g.nodes) for t in map(int, g.nodes)], "source bigint, target bigint")
    want = {(s, t): distances(g, s).get(t) for s in map(int, g.nodes) for t in map(int, g.nodes)}
    assert {(r.source, r.target): r.dist for r in hierarchy.tree_distances(q, m).collect()} == want
    nodes = spark.createDataFrame([(int(n),) for n in g.nodes], "node bigint")
    out, into = hierarchy.ancestor_labels(nodes, m, True), hierarchy.ancestor_labels(nodes, m, False)
    got = {(r.source, r.target): r.dist for r in search.label_distances(q, out, into).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_merge_metrics():
    merged = hierarchy.merge_metrics([np.array([1, 9]), np.array([2, 9]), np.array([50, 1])], 2)
    assert sorted(sorted(a) for a, _ in merged) == [[0, 1], [2]] and merged[-1][1].tolist() == [1, 9]


def test_profile_is_earliest_arrival():
    rng = np.random.default_rng(3)
    t, h = rng.integers(0, 7, 20), rng.integers(0, 7, 20)
    g = search.Graph(t, h, np.arange(20), np.ones(20, int))
    fs = {}
    for e in range(20):
        at = np.array([0, *sorted(rng.choice(np.arange(1000, 86000), 4, replace=False)), 86400], float)
        v = rng.integers(100, 4000, 6).astype(float)
        v[-1] = v[0]
        for _ in range(2):
            for k in range(4, -1, -1):
                v[k] = min(v[k], at[k + 1] + v[k + 1] - at[k])
            v[-1] = v[0]
        fs[e] = (at, v)
    s = int(g.nodes[0])
    found = routing.profile(g, fs, s)
    for d in np.linspace(0, 86399, 23):
        labels, _, _ = g.search(s, None, lambda k, now: float(kernels.value(fs[g.edge[k]], np.array([now]))[0]), start=float(d))
        for u, arrive in labels.items():
            if int(g.nodes[u]) != s:
                assert kernels.value(found[int(g.nodes[u])], np.array([d]))[0] == pytest.approx(arrive - d, abs=1e-3)


def test_alternatives():
    #  two good ways, one long one
    g = search.Graph(np.array([0, 1, 0, 2, 0, 3]), np.array([1, 9, 2, 9, 3, 9]), np.arange(6), np.array([10, 10, 11, 10, 30, 30]))
    routes = routing.penalty_alternatives(g, 0, 9)
    assert routes == [[0, 1], [2, 3]]
    q = routing.alternative_quality(g, routes, 0, 9)
    assert q["decisions"] == 1 and q["total"] == pytest.approx(2) and q["average"] == pytest.approx(41 / 40)
    assert routing.penalty_alternatives(g, 9, 0) == []


def test_traffic_aware():
    # Live weights make the way over 1 dear; the detour over 2 and 3 is long where roads are free.
    g = search.Graph(np.array([0, 1, 0, 2, 3, 0, 4]), np.array([1, 9, 2, 3, 9, 4, 9]), np.arange(7), np.array([10, 10, 20, 20, 20, 13, 13]))
    live = [100.0, 100.0, 20.0, 20.0, 20.0, 60.0, 60.0]
    live = [live[e] for e in g.edge]
    aware = routing.TrafficAware(g, live, epsilon=0.5)
    edges, proven = aware.exact(0, 9)
    assert proven and edges == [5, 6]
    edges, ok = aware.fixed(0, 9)
    assert ok and not aware._bad([0, *(int(g.nodes[g.head[g.edge.index(e)]]) for e in edges)], [g.edge.index(e) for e in edges])
    assert aware.baseline(0, 9) == [0, 1]
    assert routing.violations([1, 2, 3, 2], [1, 1, 1], lambda a, b: 1, 0.5) == [(1, 3)]


def test_per_query(spark):
    g = random_graph(8)
    q = spark.createDataFrame([(k, int(g.nodes[0]), int(n)) for k, n in enumerate(g.nodes)], "query_id bigint, source bigint, target bigint")
    rows = routing.per_query(q, g, lambda g, s, t: routing.penalty_alternatives(g, s, t, most=3)).collect()
    want = distances(g, int(g.nodes[0]))
    w = dict(zip(g.edge, g.weight, strict=True))
    assert all(sum(w[e] for e in r.edges) == want[int(g.nodes[r.query_id])] for r in rows if r.k == 0)


def follower(n=3, spans=2):
    begins = [10.0 * k for k in range(spans)]
    return routing.Follower(begins, 10.0 * spans, [100.0] * n, [1] * n, lambda e, d: 50 * max(0.0, 1 - d / 60), [[4.0] * spans for _ in range(n)])


def test_follower():
    f = follower()
    f.sampled[0, 0] = 5.0
    f.move([0], 0.0, -1)
    f.move([1], 0.0, 1)
    assert f.sampled[0, 0] < 5 and f.sampled[1, 0] == 4.0 and (2, 0) not in f.sampled
    g = follower()
    g.move([0], 8.0, 1)
    assert g.sampled == {(0, 0): 2.0, (0, 1): 2.0} or sum(g.sampled.values()) == pytest.approx(4.0)
    g.move([0], 99.0, 1)
    assert len(g.sampled) == 2
    with pytest.raises(ValueError):
        routing.Follower([10.0, 0.0], 20.0, [], [], lambda e, d: d, [])


def test_window_union():
    g = search.Graph(np.array([0, 0]), np.array([1, 1]), np.array([0, 1]), np.array([1, 1]))
    day = np.array([0.0, 40000.0, 50000.0, 86400.0])
    fs = {0: (day, np.array([10.0, 10.0, 90.0, 10.0])), 1: (day, np.array([50.0, 50.0, 50.0, 50.0]))}
    assert routing.window_union(g, fs, 0, 1, [(0, 20000), (45000, 55000)]) == {0, 1}
    assert routing.window_union(g, fs, 0, 1, [(80000, 7000)]) == {0}
