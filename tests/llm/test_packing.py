import zlib
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routeloom.llm import packing

LIBRARY = Tokenizer.from_file(packing.tokenizer_path())


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return Counter(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(lengths):
    counts = Counter(lengths)
    used, seen = defaultdict(list), Counter()
    for n, a, b, first, per, offset in packing.plan(counts, 40):
        for r in range(a, b):
            used[first + (r - a) // per].append((offset + n * ((r - a) % per), n))
            seen[n] += 1
    assert seen == counts
    remaining = Counter()
    for items in used.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 40
        remaining[40 - at] += 1
    assert remaining == plain_best_fit(lengths, 40)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t.'séß  !<|>"), max_size=30))
def test_encoder_is_the_library(text):
    assert np.frombuffer(packing.encoder(packing.tokenizer_path()).encode(text), "<u4").tolist() == library_ids(text)


def check(rows, texts):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids = np.array(library_ids(t or "") + [0], "<u4")
        got = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, s, n) for k, (s, n) in enumerate(packing.pieces_of(len(ids)))]
        for r in got:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for items in full.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048
    assert len(full) == sum(plain_best_fit([r.length for r in rows], 2048).values())


def test_whole_table(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    check(packing.op5_best_fit_packing(spark, sf_dir).collect(), texts)


def test_edges_and_sequences(spark):
    rows = [(1, None), (2, ""), (3, "x y " * 5000), (4, "a  b\t c"), (5, " lead"), (6, "<|endoftext|> x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"th": F.lit("c"), "bucket": F.lit(1), "length": F.lit(2)})
    check(packing.pack_documents(docs).collect(), dict(rows))
    again = docs.unionByName(docs).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    packed = packing.pack_documents(again)
    assert packed.where("doc_id = 2 OR doc_id IS NULL").count() == 3
    out = packing.sequences(packed, packing.pieces(again, with_ids=True)).collect()
    tokens = sorted(t for r in out for t in np.frombuffer(r.ids, "<u4").tolist())
    assert tokens == sorted([*(t for _, x in rows for t in [*library_ids(x or ""), 0])] * 2 + [0])
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_numbering_tables_follow_the_pieces(spark, monkeypatch):
    """Rare lengths have one bucket, a frequent one as many as it needs; places stay gapless."""
    monkeypatch.setattr(packing, "BUCKET_PIECES", 50)
    kept = {}
    write = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    cut = spark.range(1200).selectExpr("id AS doc_id", "id AS th", "0 AS piece", "0L AS start", "CASE WHEN id < 800 THEN 7 ELSE id % 97 + 1 END AS length", "0L AS ids_crc32")
    rows = packing.pack(cut, 128).collect()
    assert kept["pack-base"].count() <= 97 + 1200 // 50
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 1200 and len(full) == sum(plain_best_fit([r.length for r in rows], 128).values())
    for items in full.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 128
