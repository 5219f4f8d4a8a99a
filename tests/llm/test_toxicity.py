from itertools import product

import numpy as np
import pyspark.sql.functions as F

from routeloom.llm import toxicity
from routeloom.llm.labelled import fold_of


def brute_marginals(emit, trans):
    total, hit = 0.0, np.zeros(len(emit))
    for states in product((0, 1), repeat=len(emit)):
        w = np.exp(sum(e for e, s in zip(emit, states, strict=True) if s) + sum(trans[a, b] for a, b in zip(states, states[1:], strict=False)))
        total += w
        hit += w * np.array(states)
    return hit / total


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2)) * 2
    chains = [rng.normal(size=n) * 3 for n in (1, 2, 7, 10)]
    emit = np.concatenate(chains)
    ends = np.cumsum([len(c) for c in chains])
    first, last = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
    last[ends - 1] = True
    first[np.concatenate([[0], ends[:-1]])] = True
    want = np.concatenate([brute_marginals(c, trans) for c in chains])
    assert np.allclose(toxicity.marginals(emit, first, last, trans), want)
    pairs = toxicity._pairs(emit, first, last, trans)
    inner = np.flatnonzero(~first)
    assert np.allclose(pairs[inner].sum(axis=1)[:, 1], want[inner])


def plain_marginals(emit, trans):
    """Forward and backward, one place at a time."""
    a, psi = np.exp(trans), np.stack([np.ones_like(emit), np.exp(emit)], axis=1)
    f, b = psi.copy(), np.ones_like(psi)
    for t in range(len(emit)):
        f[t] = psi[t] * (f[t - 1] @ a if t else 1)
        f[t] /= f[t].sum()
    for t in range(len(emit) - 2, -1, -1):
        b[t] = a @ (psi[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    return (f * b)[:, 1] / (f * b).sum(axis=1)


def test_marginals_of_long_chains():
    rng = np.random.default_rng(5)
    for strength in (0.5, 8):  # strong transitions carry a state over thousands of places
        trans = np.array([[strength, -strength], [-strength, strength]]) + rng.normal(size=(2, 2))
        chains = [rng.normal(size=n) * 2 for n in (1, 255, 256, 257, 512, 3000, 2, 769, 40)]
        emit = np.concatenate(chains)
        ends = np.cumsum([len(c) for c in chains])
        first, last = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
        last[ends - 1] = True
        first[np.concatenate([[0], ends[:-1]])] = True
        want = np.concatenate([plain_marginals(c, trans) for c in chains])
        assert np.allclose(toxicity.marginals(emit, first, last, trans), want, atol=1e-9)


def test_tagging_against_brute_force(spark, sf_dir):
    """Scores and spans of whole texts from the weights of a trained field, word by word."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.tag(docs, field).collect():
        words = list(toxicity.WORD.finditer(texts[r.doc_id]))
        slots = [[toxicity._slot(f) for f in toxicity.features(m.group())] for m in words]
        emit = np.array([sum(field.own[s]) + field.bias for s in slots])
        emit[1:] += [field.left[s[0]] for s in slots[:-1]]
        emit[:-1] += [field.right[s[0]] for s in slots[1:]]
        p = plain_marginals(emit, field.trans) if words else np.zeros(0)
        c = min(max(1 - np.prod(1 - p * p), 1e-9), 1 - 1e-9)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(field.scale * np.log(c / (1 - c)) + field.shift, -30, 30)))) < 1e-5
        marked = [k for k in range(len(words)) if p[k] >= 0.5]
        starts = [words[k].start() for k in marked if k - 1 not in marked]
        ends = [words[k].end() for k in marked if k + 1 not in marked]
        assert [(s.start, s.end) for s in r.spans] == list(zip(starts, ends, strict=True))


def test_sample_is_bounded(spark):
    from routeloom.llm.labelled import texts_of

    docs = spark.createDataFrame([(1, "a" * 50), (1, "b"), (1, "c"), (2, "d" * 90), (3, None), (4, "e" * 30)], "doc_id bigint, text string")
    assert texts_of(docs, [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], 60) == [("b", 0), ("", 0), ("e" * 30, 1)]
    assert texts_of(docs, [], 60) == []


def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in toxicity.op6_toxicity_crf(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == (fold_of(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def sample():
    docs = [(i, f"{'say' if i % 3 else 'well'} you are a plain{'abc'[i % 3]} person number{i % 7} now words", 0) for i in range(60)]
    return docs + [(100 + i, f"{'say' if i % 3 else 'well'} you are a gruftig{'abc'[i % 3]} person number{i % 7} now words", 1) for i in range(60)]


def test_spans_edges_and_stage(spark):
    field = toxicity.fit([(t, y) for _, t, y in sample()])
    rows = [(1, None), (2, ""), (3, "say gruftigx gruftigab now"), (3, "say gruftigx gruftigab now"), (None, "plain é\U0001f600 gruftigb"), (5, "plain words " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"score": F.lit("c"), "spans": F.lit(1), "t_all": F.lit(2), "row": F.lit(3)})
    got = [(r.doc_id, r.score >= 0.5, [tuple(s) for s in r.spans]) for r in toxicity.tag(docs, field).collect()]
    assert sorted(got, key=str) == sorted([(1, False, []), (2, False, []), (3, True, [(4, 22)]), (3, True, [(4, 22)]), (None, True, [(9, 17)]), (5, False, [])], key=str)
    assert toxicity.tag(docs.limit(0), field).collect() == []
    nothing = toxicity.fit([])
    assert not any(r.score >= 0.5 for r in toxicity.tag(docs, nothing).collect())


def test_stage_keeps_columns(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in sample()] + [(None, 0, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t, _ in sample()] + [(None, None, None, "s", None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = toxicity.toxicity_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*range(60), None], key=str)


def test_oracle_sql_is_text():
    from routeloom.llm import queries

    assert all(isinstance(sql, str) for sql in queries.ORACLE_SQL.values()) and "op6_toxicity_crf" in queries.QUERIES
