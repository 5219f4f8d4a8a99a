from itertools import combinations

import numpy as np
import pyspark.sql.functions as F
import pytest
import xxhash

from routeloom.llm import simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def test_golay_is_perfect():
    words = np.arange(1 << 23)
    assert (np.bincount(simhash.golay_index(words), minlength=4096) == 2048).all()


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), 1 << 63, 300)
    for _ in range(20):
        i, j = rng.choice(64, 2, replace=False)
        b = (a.view(np.uint64) ^ np.uint64((1 << int(i)) | (1 << int(j)))).view(np.int64)
        ra, ka = simhash.fuzzy_keys(a)
        rb, kb = simhash.fuzzy_keys(b)
        for r in range(len(a)):
            assert set(ka[ra == r]) & set(kb[rb == r])


@pytest.mark.parametrize("cut", [0, 24])
def test_links_join_what_brute_force_joins(spark, cut):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 8)
    out = set()
    for x in map(int, base):
        for _ in range(60):  # chains of copies, each some bits from one before
            x ^= sum({1 << int(i) for i in rng.choice(60, rng.integers(1, 4))})
            out.add(x)
    prints = sorted(out)
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    from routeloom.llm.components import connected_components

    got = dict(connected_components(simhash.links(df, cut)).collect())
    want = brute_components({x: x & (1 << 64) - 1 for x in prints})
    assert {x: got.get(x, x) for x in prints} == want


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    comps = brute_components(prints)
    got = simhash.op9_simhash_golay(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", comps[i]) for i, p in prints.items()}


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \n", "x"), (7, "Ab c", "y"), (7, "Ab c", "y"), (8, "aB  C", None), (9, "Äb c d e", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").withColumn("fp", F.lit("clash")).withColumn("label", F.lit(0))
    got = {(r.doc_id, r.fp, r.rep_id) for r in simhash.near_duplicates(docs).collect()}
    zero = {(1, 0, 1), (2, 0, 1), (None, 0, 1)}
    assert zero <= got and {r[2] for r in got if r[0] in (7, 8)} == {7} and len(got) == 6
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    kept = simhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9]


def brute_similar(texts):
    """Smallest id of each component over links of 5-word similarity 0.8."""
    shingles = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        shingles[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    rep = {i: i for i in texts}
    members = {i: [i] for i in texts}
    for a, b in combinations(sorted(texts), 2):
        x, y = shingles[a], shingles[b]
        if rep[a] != rep[b] and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
            lo, hi = sorted((rep[a], rep[b]))
            for i in members.pop(hi):
                rep[i] = lo
                members[lo].append(i)
    return rep


def test_stage_links_similar_texts(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(500)]
    texts, i = {}, 0
    for size in (6, 40, 120, 400):
        for _ in range(6):
            words = list(rng.choice(vocabulary, size))
            for share in (0, 0.01, 0.02, 0.03, 0.2):  # copies ever further away, in a chain
                for k in rng.choice(size, int(share * size), replace=False):
                    words[k] = f"new{i}"
                texts[i], i = " ".join(words), i + 1
    star = list(rng.choice(vocabulary, 100))
    for k in range(100):  # a crowd around one text, most of it not similar among itself
        texts[i], i = " ".join([*star[: k], f"x{k}", *star[k + 1 :]]), i + 1
    texts[i], texts[i + 1] = "a b c d e f g h i", "a b c d e f g h i j"  # five and six shingles: 0.83
    want = brute_similar(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.rep_id for r in simhash.similar_texts(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.dedup_stage(spark, docs, "").collect()) == sorted(set(want.values()))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for size in (1, 30, 300, 5000):
        base = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        for share in (0, 0.05, 0.2, 1):
            other = np.where(rng.random(size) < share, rng.integers(0, 1 << 32, size, dtype=np.uint32), base)
            apart = int(np.bitwise_count((simhash.parities(np.unique(base)) ^ simhash.parities(np.unique(other))).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(base, other)) and (share or not apart)


def test_stage_makes_few_pairs_of_a_crowd(spark, monkeypatch):
    """Near copies of one text, most of them not similar among themselves, aren't paired with each other."""
    rng = np.random.default_rng(4)
    star, texts = [f"w{k}" for k in rng.choice(5000, 160)], {}
    for i in range(200):
        words = list(star)
        for k in rng.choice(len(words), 2 + i % 5, replace=False):
            words[k] = f"x{rng.integers(100_000)}"
        texts[i] = " ".join(words)
    want, made, written = brute_similar(texts), [], simhash.written

    def counted(df, name):
        out = written(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.rep_id for r in simhash.similar_texts(docs).collect()} == want
    assert len(set(want.values())) > 20 and sum(made) < 10 * len(texts)


def test_stage_names_and_repeats(spark):
    rows = [(1, "one two three four five six", 3, None), (1, "one two three four five six", 2, "z"), (2, "ONE two  three four five six", 1, "a"), (None, None, 0, ""), (None, "", 5, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, kept string").withColumn("row", F.lit("r")).withColumn("th", F.lit(0)).withColumn("h", F.lit(1)).withColumn("id", F.lit(2)).withColumn("label", F.lit(4))
    kept = simhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n, r.kept) for r in kept.collect()), key=str) == [(1, "one two three four five six", 2, "z"), (None, None, 0, "")]
    assert simhash.dedup_stage(spark, docs.limit(0), "").collect() == []


def test_stage_takes_very_long_texts(spark):
    words = [f"w{k % 977}x{k % 1009}" for k in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[100_000:]))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.dedup_stage(spark, docs, "").collect()) == [1, 3]


def test_golay_keys_find_similar_texts(spark, sf_dir):
    """Recall on distinct texts of the table: of all that are similar, nearly all are linked."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = brute_similar(texts)
    got = {r.doc_id: r.rep_id for r in simhash.similar_texts(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)
    assert all(got[i] == i for i in want if want[i] == i)
