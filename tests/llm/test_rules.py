from collections import Counter

import duckdb
import pyspark.sql.functions as F

from routeloom.llm import rules


def brute(text):
    t = text or ""
    flat = t
    for c in "\t\n\v\f\r":
        flat = flat.replace(c, " ")
    w = [x for x in flat.split(" ") if x]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if any(c not in " \t\v\f\r" for c in x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_whole_table(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = rules.op2_rule_ledger(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLS) == brute(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(rules.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)


def test_keeps_good_documents(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    got = rules.op2_rule_ledger(spark, sf_dir).where("NOT base_failed").join(good, "doc_id")
    assert got.where("NOT kept").count() == 0


def test_edges_and_ablation(spark):
    again = "a b c d e f g h i j " * 4
    rows = [(1, None), (None, ""), (3, " \n\t "), (4, again), (4, again), (5, "ok " + " ".join(f"w{i}" for i in range(30))), (6, "\n\nx y\nx y\né\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_t": F.lit("clash"), "n_words": F.lit(9)})
    entries = rules.ledger(docs)
    got = entries.collect()
    assert sorted(map(str, [(r.doc_id, tuple(r[c] for c in COLS)) for r in got])) == sorted(map(str, [(i, brute(t)) for i, t in rows]))
    kept = {r.doc_id: r.kept for r in rules.apply_policy(entries).collect()}
    assert kept == {1: False, None: False, 3: False, 4: False, 5: True, 6: False}
    table = {r.rule: r for r in rules.ablation(entries).collect()}
    assert set(table) == {"few_words", "repeated_windows", "symbols", "stutter", "no_letters"}
    assert (table["few_words"].failed, table["few_words"].failed_alone) == (4, 1)
    assert (table["repeated_windows"].failed, table["repeated_windows"].failed_alone) == (2, 2)
    assert rules.ledger(docs.limit(0)).collect() == [] and rules.ablation(entries.limit(0)).collect() == []
