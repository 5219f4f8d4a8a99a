"""Steps that must stay small or spread as tables grow."""

import re

import numpy as np
from pyspark.sql import functions as F

from routeloom.operators import analysis, potentials, search
from routeloom.plans import queries
from routeloom.sources import formats, sinks


def test_arrivals_have_the_last_bits_of_the_formula(spark):
    """Near ties are decided by them, in SQL as here."""
    day, rng = 86_400.0, np.random.default_rng(0)
    v, u = 1834.567, 2977.123
    g = search.Graph(np.array([0]), np.array([1]), np.array([0]), None, [([0.0, 3600.0, day], [v, u, v])])
    q = spark.createDataFrame([(0, 1, round(float(t), 3)) for t in rng.uniform(0, 3600, 300)], "source bigint, target bigint, departure double")
    for r in potentials.td_with_ranks(q, g, day).collect():
        t = r.departure
        assert r.dist == t + v + (t - 0.0) * (u - v) / (3600.0 - 0.0) - t and r.settled == 2


def test_queries_are_spread_over_tasks(spark):
    q = spark.range(100).selectExpr("id AS query_id", "id % 7 AS source", "id % 5 AS target").coalesce(1)
    each = search.spread(q).rdd.glom().collect()
    assert sum(map(len, each)) == 100 and len([p for p in each if p]) == 4
    assert all([r.target for r in p] == sorted(r.target for r in p) for p in each)


def test_large_batches_are_several_files_in_order(spark, tmp_path):
    rows = spark.range(4000).selectExpr("0 AS batch", "concat('q', id) AS id", "CAST(id % 977 AS DOUBLE) AS depart", "array('a', 'b') AS edges")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if partitions were large
    try:
        sinks.write_batches(rows, str(tmp_path / "b"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "b" / "batch=0").glob("*.xml"))
    departs = [float(d) for f in files for d in re.findall(r'depart="([^"]+)"', f.read_text())]
    assert len(files) > 1 and len(departs) == 4000 and departs == sorted(departs)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"".join(b"line %d\r\n" % k for k in range(9000)))
    (tmp_path / "b.txt").write_text("x\n\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = formats.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert sorted((r.line, r.value) for r in lines.collect()) == [(k, f"line {k}") for k in range(9000)]
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 3
        assert "wholetext" not in lines._jdf.queryExecution().toString().lower()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.value) for r in formats.numbered_lines(spark, str(tmp_path / "b.txt")).collect()) == [(0, "x"), (1, ""), (2, "y")]


def test_percentiles_are_exact_without_a_groups_values_in_one_place(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS g", "CAST((id * 7919) % 500 AS DOUBLE) / 7 AS v")
    got = {r.g: (r.a, r.b) for r in analysis.percentiles(rows, ["g"], "v", {"a": 0.25, "b": 0.5}).collect()}
    want = {r.g: (r.a, r.b) for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.25)).alias("a"), F.percentile("v", F.lit(0.5)).alias("b")).collect()}
    assert got == want and len(want) == 3
    assert "percentile(" not in analysis.describe(rows, "v")._jdf.queryExecution().toString()


def test_paths_gather_no_functions(spark, sf_dir):
    plan = queries.QUERIES["F10_N9_path_times"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(pos" in plan and "f#" not in plan.split("collect_list(struct(pos")[1].split(")")[0]


def test_small_derived_tables_are_computed_once(spark, sf_dir):
    t = queries.Tables(spark, sf_dir)
    for name in ("edges", "points"):
        plan = getattr(t, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
