"""Every road query against its SQL, and those without SQL for rows."""

import oracle
import pytest

from routeloom.plans import graph_queries, io_queries, queries  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE_SQL:
        assert not oracle.differences(df, queries.ORACLE_SQL[name], con)
    else:
        assert df.count() > 0


def test_profiles_change_after_the_fourth_road(spark, sf_dir):
    tables = queries.Tables(spark, sf_dir)
    road = "SELECT * FROM VALUES (101, 1, 2, 1, 0), (102, 1, 2, 1, 0), (103, 1, 2, 1, 0), (104, 1, 2, 1, 0), (105, 1, 2, 2, 0) AS r(road_id, tail, head, lanes, priority)"
    tables._made["roads"] = spark.sql(road)
    assert [tuple(r) for r in queries.whole_profiles(tables).collect()] == [(1, 2, "1,1,1")]
