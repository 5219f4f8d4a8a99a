import re
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from routeloom.llm import mixing


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        t = {s: left * weight[s] / w for s in free}
        over = [s for s in free if t[s] > 3 * size[s]]
        if not over:
            return fixed | t
        fixed |= {s: 3.0 * size[s] for s in over}


def check(rows, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for _, t, s in docs:
        size[s] += words(t)
    want, taken, largest = brute_targets(size), Counter(), defaultdict(int)
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=str) == sorted(((i, s, words(t)) for i, t, s in docs), key=str)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1e-6


def read(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("block", [mixing.BLOCK, 7])
def test_whole_table(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs, block).collect()
    check(got, read(spark, sf_dir))
    again = mixing.mix(docs.repartition(7), block).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    units = [(k, int(rng.integers(1, 900)), float(rng.choice([0.25, 0.6]))) for k in range(2000)]
    done = list(mixing.fly(iter(units), rng))
    assert sorted(k for k, _, _ in done) == list(range(2000)) and sum(0 < p < 1 for *_, p in done) <= 2
    assert sum(p for *_, p in done) == pytest.approx(sum(p for *_, p in units))
    assert sum(s * p for _, s, p in done) == pytest.approx(sum(s * p for _, s, p in units))


def test_flight_keeps_expectations():
    units = [(k, k % 5 + 1, 0.3) for k in range(12)]
    n = np.zeros(12)
    for seed in range(4000):
        for k, _, p in mixing.fly(iter(units), np.random.default_rng(seed)):
            n[k] += p
    assert np.abs(n / 4000 - 0.3).max() < 0.04


def test_edges(spark):
    docs = [(i, "w " * (i % 9 + 1), "abc"[i % 3]) for i in range(300)] + [(500, None, None), (501, "x y", None), (None, "n", "a"), (None, "n", "a"), (7, "w " * 8, "b"), (600, "", "zz"), (601, " ", "zz")]
    rows = [(i, t, s, "en", len(t or "")) for i, t, s in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").withColumns({"size": F.lit("c"), "p": F.lit(1), "block": F.lit(2)})
    got = mixing.mix(df).collect()
    check(got, docs)
    assert mixing.mix(df.limit(0)).collect() == []
    staged = mixing.mix_stage(spark, df, "")
    assert staged.columns == df.columns
    have = Counter((r.doc_id, r.text) for r in staged.collect())
    want = Counter()
    texts = {(i, len((t or "").split())): t for i, t, _ in docs}
    for r in got:
        want[r.doc_id, texts[r.doc_id, r.size]] += r.copies
    assert have == +want


def test_blocks_that_cannot_shrink_raise(spark):
    units = spark.createDataFrame([(i, 0, 1, "a", i % 7 + 1, 0.3) for i in range(40)], mixing.UNIT)
    with pytest.raises(ValueError, match="shrink"):
        mixing.balance(units, 1)


def test_clashing_names_and_long_texts(spark):
    names = ["m_text", "m_id", "m_copies", "row", "id", "h", "of", "copies", "n", "k", "th", "size"]
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x", "b"), (3, "y y", "b")], "doc_id bigint, text string, source string").withColumns({c: F.lit(c) for c in names})
    out = mixing.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == c for r in rows for c in names)
