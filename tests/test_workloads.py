import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from routeloom.functions import ttf
from routeloom.operators import search, workloads
from tests_support import distances, random_graph


@pytest.fixture(scope="module")
def edges(spark):
    g = random_graph(3)
    tail = [int(g.nodes[u]) for u in range(len(g.nodes)) for _ in range(g.first[u], g.first[u + 1])]
    rows = [(int(e), t, int(g.nodes[h]), int(w)) for e, t, h, w in zip(g.edge, tail, g.head, g.weight, strict=True)]
    return spark.createDataFrame(rows, "edge_id bigint, tail bigint, head bigint, weight bigint")


def test_guided_searches():
    for seed in range(6):
        g = random_graph(seed)
        back, marks = workloads.reversed_graph(g), workloads.landmark_tables(g, 3)
        for s in map(int, g.nodes):
            want = distances(g, s)
            for t in map(int, g.nodes):
                d = want.get(t)
                assert workloads.bidirectional(g, back, s, t) == d
                assert workloads.a_star(g, s, t, workloads.landmark_bound(marks, t))[0] == d
                assert workloads.a_star(g, s, t, workloads.exact_bounds(g, t))[0] == d


def test_query_sets_and_components(spark, edges):
    q = workloads.uniform_queries(spark, 10, 200, 3, 1000)
    rows = q.collect()
    assert len(rows) == 200 and all(0 <= r.source < 10 and 0 <= r.departure < 1000 for r in rows) and len({r.source for r in rows}) == 10
    dist = search.relax(edges, spark.createDataFrame([(0,), (1,)], "source bigint"))
    assert {r["rank"] for r in workloads.rank_queries(dist).collect()} <= {0, 1, 2, 3}
    assert workloads.ball_queries(dist, 4, 2, 1).count() == 4
    assert workloads.far_queries(dist, 20).count() <= 2
    assert workloads.disagreements(dist, dist, ["source", "node"]).count() == 0
    two = edges.unionByName(spark.createDataFrame([(99, 500, 501, 1)], edges.schema))
    label = {r.node: r.component for r in workloads.components(two).collect()}
    assert label[500] == label[501] == 500 and label[500] not in {v for k, v in label.items() if k < 500}
    asked = spark.createDataFrame([(500, 501), (500, 0)], "source bigint, target bigint")
    assert workloads.connected_only(asked, workloads.components(two)).count() == 1


def test_live(spark):
    f = spark.createDataFrame([(1, a, v) for a, v in ((0, 100), (1000, 400), (86_400_000, 100))] + [(2, 0, 5)], "edge_id int, at bigint, val bigint").groupBy("edge_id").agg(ttf.collect().alias("f"))
    got = {r.edge_id: [tuple(p) for p in r.f] for r in workloads.set_at(f, spark.createDataFrame([(1, 1000, 50)], "edge_id int, at bigint, val bigint")).collect()}
    assert got == {1: [(0, 100), (1000, 50), (86_400_000, 100)], 2: [(0, 5)]}
    with pytest.raises(Exception, match="no such point"):
        workloads.set_at(f, spark.createDataFrame([(1, 7, 50)], "edge_id int, at bigint, val bigint")).collect()
    live = spark.createDataFrame([(1, 9, 10), (2, None, 5), (3, 4, 10**9)], "edge_id int, live bigint, duration bigint")
    e, counts = workloads.live_overlay(spark.createDataFrame([(1,), (3,)], "edge_id int"), live, 100, 86_400_000)
    assert sorted((r.edge_id, r.live, r.until) for r in e.collect()) == [(1, 9, 110), (3, None, None)]
    assert tuple(counts.first()) == (3, 1, 1)
    flat = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(v).alias("val")) for a, v in ((0.0, 10.0), (500.0, 10.0), (86400.0, 10.0))])
    p = spark.range(1).select(workloads.patched(flat, F.lit(60.0), F.lit(100.0), F.lit(200.0)).alias("p")).first().p
    assert [x.val for x in p if 100 <= x.at <= 200] == [60.0, 60.0] and all(a.at + a.val <= b.at + b.val + 1e-9 for a, b in zip(p[1:], p[2:], strict=False))


def test_windows_tests_and_trips(spark):
    f = spark.createDataFrame([(1, a, v) for a, v in ((0, 100), (1000, 400), (2000, 50), (86_400_000, 100))], "edge_id int, at bigint, val bigint").groupBy("edge_id").agg(ttf.collect().alias("f"))
    b = workloads.window_bounds(f, [(0, 1000), (1000, 2000)]).orderBy("k").collect()
    assert [(r.lo, r.hi) for r in b] == [(100, 400), (50, 400)]
    assert workloads.day_windows(1)[0] == (6, 7) and (14, 22) in workloads.day_windows(1)
    x, y = np.random.default_rng(0).normal(0.5, 1, 60), np.zeros(60)
    r = workloads.paired_tests(spark.createDataFrame([("g", float(a), float(c)) for a, c in zip(x, y, strict=True)], "g string, a double, b double"), ["g"], "a", "b").first()
    assert r.t == pytest.approx(x.mean() / (x.std(ddof=1) / math.sqrt(60))) and 0 <= r.p_rank < 0.05
    ranks = np.argsort(np.argsort(np.abs(x))) + 1
    assert r.w_plus == ranks[x > 0].sum()
    t = workloads.random_trips(spark.range(9).withColumnRenamed("id", "node_id"), {0: 3, 2: 1}, 60, 1).collect()
    assert sorted(x.depart for x in t) == [0.0, 20.0, 40.0, 120.0]


def test_chains(spark):
    rows = [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 4), (4, 9, 5), (0, 9, 7), (9, 0, 1), (9, 7, 2), (7, 9, 2)]
    e = spark.createDataFrame(rows, "tail int, head int, weight bigint")
    got = sorted(tuple(r) for r in workloads.contract_chains(e).collect())
    assert (0, 9, 15) in got and (0, 9, 7) in got and (9, 0, 1) in got and all(t in (0, 9) for t, _, _ in got)
