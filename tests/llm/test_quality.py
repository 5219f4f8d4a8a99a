import numpy as np
import pyspark.sql.functions as F

from routeloom.llm import quality
from routeloom.llm.labelled import fold_of


def test_risk_finds_the_negatives_among_the_unlabelled():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (4000, 5)), rng.normal(2.5, 1, (1000, 5))
    p, u = good[:1500], np.concatenate([good[1500:], bad])
    net = quality.fit(p, u, 2500 / 3500)
    assert (net.score(good[1500:]) >= 0.5).mean() > 0.95 and (net.score(bad) < 0.5).mean() > 0.95


def test_prior():
    rng = np.random.default_rng(2)
    p = np.histogram(rng.beta(5, 2, 5000), 400, (0, 1))[0]
    u = np.histogram(np.concatenate([rng.beta(5, 2, 7000), rng.beta(1, 6, 3000)]), 400, (0, 1))[0]
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.05


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op3_quality_pu(spark, sf).collect()}
    assert all(r.held_out == (fold_of(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(r.quality, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b\nc"), (3, "a b\nc"), (None, "\U0001f600 " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"f": F.lit("c"), "score": F.lit(1)})
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 1), (99, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, 3, None] and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []
