"""The pipeline, each stage against its brute-force version on the stage's own input."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
import test_linededup
import test_mixing
import test_packing
import test_simhash

from routeloom.llm import common, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = common.written(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]

    # Toxicity: what is left is what the field, trained alike, doesn't find toxic.
    first = seen["toxicity"]
    field = toxicity.train(first, common.table(spark, SF, "labels"))
    clean = {r.doc_id for r in toxicity.tag(first, field).collect() if r.score < 0.5}
    assert {i for (i,) in rows(seen["line_dedup"], "doc_id")} == clean

    given = rows(seen["line_dedup"], "doc_id", "text")
    gone = test_linededup.brute(given)
    want = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in given}
    assert dict(rows(seen["simhash_near_dedup"], "doc_id", "text")) == want

    comps = test_simhash.brute_similar(want)
    assert sorted(i for (i,) in rows(seen["source_mixing"], "doc_id")) == sorted(set(comps.values()))

    mixed_in = rows(seen["source_mixing"], "doc_id", "text", "source")
    size, copies = {i: len(words_of(t)) for i, t, _ in mixed_in}, Counter(i for (i,) in rows(seen["best_fit_packing"], "doc_id"))
    per, taken, largest = Counter(), Counter(), defaultdict(int)
    for i, _, s in mixed_in:
        per[s] += size[i]
        taken[s] += copies[i] * size[i]
        largest[s] = max(largest[s], size[i])
        assert copies[i] <= 3
    goal = test_mixing.brute_targets(per)
    assert all(abs(taken[s] - goal[s]) <= 2 * largest[s] + 1e-6 for s in per)

    texts = dict(rows(seen["best_fit_packing"], "doc_id", "text"))
    pieces = docs.collect()
    n = Counter(r.doc_id for r in pieces if r.piece == 0)
    assert n == copies
    full = defaultdict(list)
    for r in pieces:
        full[r.sequence_id].append((r.offset, r.length))
        assert r.length <= 2048
    for items in full.values():
        at = 0
        for o, length in sorted(items):
            assert o == at
            at += length
        assert at <= 2048
    assert all(sum(r.length for r in pieces if r.doc_id == i) == k * (len(test_packing.library_ids(texts[i] or "")) + 1) for i, k in list(copies.items())[:40])


def words_of(text):
    flat = text or ""
    for c in "\t\n\v\f\r":
        flat = flat.replace(c, " ")
    return [w for w in flat.split(" ") if w]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
