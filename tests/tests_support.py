import numpy as np

from routeloom.operators import search


def random_graph(seed, n=14, m=40, top=30):
    rng = np.random.default_rng(seed)
    t, h = rng.integers(0, n, m), rng.integers(0, n, m)
    return search.Graph(t, h, np.arange(m), rng.integers(1, top, m))


def distances(g, s):
    labels, _, _ = g.search(s, None, lambda k, _: g.weight[k])
    return {int(g.nodes[u]): d for u, d in labels.items()}
