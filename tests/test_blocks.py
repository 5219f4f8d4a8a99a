"""Searches and contraction by blocks against plain searches, with small blocks."""

import numpy as np
import pytest
from tests_support import distances, random_graph

from routeloom.operators import contraction, search


def strip(rows, wide=3, seed=5):
    """A long strip of houses, as the city's streets."""
    rng, n = np.random.default_rng(seed), rows * wide
    pairs = [(u, v) for u in range(n) for v in (u + wide, u + 1 if (u + 1) % wide else n) if v < n]
    t, h = np.array(pairs + [(v, u) for u, v in pairs]).T
    return search.Graph(t, h, np.arange(len(t)), rng.integers(1, 60, len(t)))


def edges_of(spark, g):
    tail = np.repeat(g.nodes, np.diff(np.asarray(g.first)))
    rows = [(int(t), int(g.nodes[h]), int(w)) for t, h, w in zip(tail, g.head, g.weight, strict=True)]
    return spark.createDataFrame(rows, "tail bigint, head bigint, weight bigint")


def want(g, sources):
    return {(s, v): d for s in sources for v, d in distances(g, s).items()}


GRAPHS = {"strip": lambda: strip(40), "random": lambda: random_graph(2, 30, 90)}


@pytest.mark.parametrize("kind", GRAPHS)
@pytest.mark.parametrize("size", [60, 1000])
def test_distances_by_blocks(spark, kind, size):
    g = GRAPHS[kind]()
    sources = [int(g.nodes[0]), int(g.nodes[7])]
    got = search.distances(edges_of(spark, g), spark.createDataFrame([(s,) for s in sources], "source bigint"), size=size)
    assert {(r.source, r.node): r.dist for r in got.collect()} == want(g, sources)


def test_rounds_are_blocks_and_unfinished_ones_raise(spark):
    """A path of 120 edges in one block takes one round; in blocks of ten it takes more than three."""
    e = spark.createDataFrame([(k, k + 1, 1) for k in range(120)], "tail bigint, head bigint, weight bigint")
    one = spark.createDataFrame([(0,)], "source bigint")
    assert search.distances(e, one, max_rounds=1).count() == 121
    with pytest.raises(RuntimeError, match="rounds"):
        search.distances(e, one, max_rounds=3, size=10)


@pytest.mark.parametrize("kind", GRAPHS)
@pytest.mark.parametrize("size", [60, 1000])
def test_contraction_by_blocks(spark, kind, size):
    g = GRAPHS[kind]()
    arcs, core = contraction.contract(edges_of(spark, g), 5, size)
    sources = [int(g.nodes[0]), int(g.nodes[7])]
    out = contraction.labels(spark.createDataFrame([(s,) for s in sources], "node bigint"), arcs, core, True)
    assert {(r.source, r.node): r.dist for r in contraction.sweep(arcs, out).collect()} == want(g, sources)
    rounds = arcs.agg({"round": "max"}).first()[0]
    assert rounds == 0 if size == 1000 else rounds > 0
