import random

import duckdb
import pyspark.sql.functions as F

from routeloom.llm import linededup

WS = " \t\v\f\r"


def brute(docs, least=linededup.MIN_WORDS):
    """By definition: a line goes if a run around it of enough words occurs before, at a place that
    the run doesn't overlap."""
    worded = {}
    for key, text in docs:
        lines = (text or "").split("\n")
        words = ["".join(" " if c in WS else c for c in x).split(" ") for x in lines]
        worded[key] = [(i, x, n) for i, (x, w) in enumerate(zip(lines, words, strict=True)) if (n := sum(map(bool, w)))]
    seen, out = {}, {k: set() for k in worded}
    for key in sorted(worded):
        a = worded[key]
        for s in range(len(a)):
            n = 0
            for e in range(s, len(a)):
                n += a[e][2]
                run = tuple(x for _, x, _ in a[s : e + 1])
                if n >= least:
                    if run not in seen:
                        seen[run] = (key, s, e)
                    elif seen[run][0] != key or seen[run][2] < s:
                        out[key] |= {i for i, _, _ in a[s : e + 1]}
                if n - a[s][2] >= least:  # longer runs are unions of shorter ones
                    break
    return out


def test_random_texts(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([1, 7, 20, 30, 49, 50, 60]))) for _ in range(14)]
    docs = [(100 + k, "\n".join([pool[3]] * k)) for k in range(8)]  # copies that overlap
    for i in range(60):
        lines = [rng.choice([*pool, "", " \t", f"own {i} {rng.random()}"]) for _ in range(rng.randrange(0, 14))]
        docs.append((i, "\n".join(lines)))
    want = brute(docs)
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in docs}
    assert {r.row.doc_id: r.text for r in out} == kept
    assert {r.row.doc_id: r.n_deleted for r in out} == {i: len(g) for i, g in want.items()}


def test_whole_table_and_sql(spark, sf_dir):
    got = linededup.op7_line_winnowing(spark, sf_dir).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    texts = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}
    assert {r.doc_id: r.text for r in got} == texts and any(want.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = con.execute(linededup.ORACLE).fetchall()
    assert sorted(map(str, sql)) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_deleted)) for r in got)


def test_edges(spark):
    p = " ".join(f"w{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, p), (4, f"x\n{p}\n\ny"), (5, f"q\n{p}"), (5, f"q\n{p}"), (None, p), (6, f"{p}\n{p}"), (7, "short line\nshort line")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_chars": F.lit(7).cast("bigint"), "lines": F.lit("c"), "th": F.lit(1), "windows": F.lit(2)})
    out = linededup.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    want = [(1, None, 7), (2, "", 7), (3, p, 7), (4, "x\n\ny", 4), (5, "q", 1), (5, "q", 1), (None, "", 0), (6, "", 0), (7, "short line\nshort line", 7)]
    assert got == sorted(want, key=str)
    assert linededup.dedup_stage(spark, docs.limit(0), "").collect() == []


def test_first_copy_stays_whole_where_copies_overlap(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(k, "\n".join([line] * k)) for k in (4,)] + [(9, f"{line}\n{line}")], "doc_id bigint, text string")
    got = {r.row.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == {4: f"{line}\n{line}", 9: ""}


def test_many_lines(spark):
    lines = [f"line {k % 7000} " + "x " * (k % 7) for k in range(20_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[-300:]) + "\nown end")]
    got = {r.row.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = brute(docs)
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in docs}
    assert got[2] == "own end"


def test_clashing_names(spark):
    p = " ".join(f"w{i}" for i in range(55))
    names = ["l_text", "l_lines", "l_id", "l_th", "l_gone", "row", "id", "key", "gone", "of", "h", "n_lines", "n_deleted", "print", "at"]
    docs = spark.createDataFrame([(1, f"a\n{p}"), (2, f"{p}\nb")], "doc_id bigint, text string").withColumns({c: F.lit(c) for c in names})
    out = linededup.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, f"a\n{p}"), (2, "b")]
    assert all(r[c] == c for r in out.collect() for c in names)
