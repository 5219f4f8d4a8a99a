"""Cases with known values of travel-time functions, choice and search."""

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.functions import ttf
from routeloom.operators import assignment, search


def function(at, val):
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("at"), F.lit(v).cast("bigint").alias("val")) for a, v in zip(at, val, strict=True)])


def test_hits_and_interpolation(spark):
    f = function([0, 6, 9, 14, 17, 20, 24], [2, 1, 3, 2, 4, 1, 2])
    t = spark.range(24).select("id", ttf.eval_ms(f, F.col("id"), 24).alias("v"))
    assert {r.id: r.v for r in t.collect() if r.id in (14, 17)} == {14: 2, 17: 4}
    g = function([0, 5, 9, 14, 17, 20, 24], [1, 1, 3, 2, 4, 1, 1])
    got = {r.id: r.v for r in spark.range(24).select("id", ttf.eval_ms(g, F.col("id"), 24).alias("v")).collect()}
    want = {0: 1, 6: 1, 7: 2, 8: 2, 10: 2, 11: 2, 12: 2, 13: 2, 15: 2, 16: 3, 18: 3, 19: 2, 23: 1}
    assert {k: got[k] for k in want} == want


def test_column_and_kernel_agree(spark):
    at, val = [0, 100, 300, 700, 1000], [50, 90, 20, 300, 50]
    got = spark.range(0, 2000, 7).select("id", ttf.eval_ms(function(at, val), F.col("id"), 1000).alias("v")).collect()
    assert all(r.v == search.eval_points((at, val), r.id, 1000) for r in got)


def test_inverse_and_crop(spark):
    f = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(v).alias("val")) for a, v in ((0.0, 10.0), (100.0, 50.0), (400.0, 20.0), (86400.0, 10.0))])
    d = spark.range(0, 80000, 997).select((F.col("id") + 0.25).alias("t"))
    back = d.select("t", ttf.departure_for(f, F.col("t") + ttf.eval_s(f, F.col("t"))).alias("b")).collect()
    assert all(abs(r.t - r.b) < 1e-6 for r in back)
    c = spark.range(1).select(ttf.crop(f, F.lit(50.0), F.lit(250.0)).alias("c")).first().c
    assert [(p.at, p.val) for p in c] == [(50.0, 30.0), (100.0, 50.0), (250.0, 35.0)]


def test_fifo_clamp(spark):
    f = spark.range(1).select(ttf.fifo(function([0, 10_000], [20_000, 6_000])).alias("f")).first().f
    assert [p.val for p in f] == [16_000, 6_000]


def test_gawron_values(spark):
    costs = [569.10, 560.00, 555.70, 555.68, 555.90]
    c, p = F.array(*map(F.lit, costs)), F.array(*map(F.lit, [0.13094327, 0.19342774, 0.22657958, 0.22577343, 0.22327598]))
    got = spark.range(1).select(assignment.gawron(c, p, 0.5).alias("p")).first().p
    # The chosen route's cost isn't smoothed, and the others had the same cost before.
    assert got == pytest.approx([0.12916244, 0.19314789, 0.22728348, 0.22647978, 0.22392642], abs=1e-4)
    assert sum(got) == pytest.approx(1)


def test_smoothing_and_prune(spark):
    s = spark.range(1).select(assignment.smoothed_costs(F.array(F.lit(10.0), F.lit(15.0)), F.array(F.lit(8.0), F.lit(12.0)), F.lit(0), 0.7).alias("c")).first().c
    assert s == pytest.approx([10, 14.1])
    a = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.4, 0.3, 0.2, 0.1])], "query_id int, alt_ix int, prob double")
    kept = assignment.prune(a, 3).collect()
    assert len(kept) == 3 and sum(r.prob for r in kept) == pytest.approx(1)


def test_tiny_graphs(spark):
    first, head, weight = [0, 2, 3, 6, 8, 8, 8], [2, 1, 3, 1, 3, 4, 0, 4], [10, 1, 2, 1, 3, 1, 7, 2]
    rows = [(k, t, head[k], weight[k]) for t in range(6) for k in range(first[t], first[t + 1])]
    edges = spark.createDataFrame(rows, "edge_id int, tail int, head int, weight bigint")
    q = spark.createDataFrame([(0, 1), (0, 3), (3, 0), (0, 4), (4, 0), (99, 0)], "source int, target int")
    want = {(0, 1): 1, (0, 3): 3, (3, 0): 7, (0, 4): 5, (4, 0): None, (99, 0): None}
    graph = search.load_graph(edges)
    got = search.dijkstra(q, graph).collect()
    assert {(r.source, r.target): r.dist for r in got} == want
    r = next(r for r in got if (r.source, r.target) == (0, 4))
    assert sum(weight[e] for e in r.edge_path) == 5 and r.node_path[0] == 0 and r.node_path[-1] == 4
    far = {(r.source, r.node): r.dist for r in search.relax(edges, q.select("source").distinct()).collect()}
    assert {k: far.get(k) for k in want} == want
    with pytest.raises(ValueError):
        search.load_graph(edges, max_edges=3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 9)), min_size=1, max_size=25))
def test_kernel_is_shortest(rows):
    import numpy as np

    t, h, w = (np.array(x) for x in zip(*rows, strict=True))
    g = search.Graph(t, h, np.arange(len(t)), w)
    best = {v: 0 if v == t[0] else 10**9 for v in {*t.tolist(), *h.tolist()}}
    for _ in range(8):
        for a, b, c in rows:
            best[b] = min(best[b], best[a] + c)
    labels, _, _ = g.search(int(t[0]), None, lambda k, _: g.weight[k])
    assert {int(g.nodes[u]): d for u, d in labels.items()} == {v: d for v, d in best.items() if d < 10**9}
