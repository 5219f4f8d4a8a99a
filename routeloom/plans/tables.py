"""The benchmark's tables and the road tables that are derived from them.

Each derived table is one SQL text that both Spark and DuckDB run: ``{name}`` stands for a
base or derived table. Spark gets DataFrames, the checking SQL a chain of WITH clauses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from routeloom.operators.tables import written

PERIOD_MS = 86_400_000

DERIVED = {
    # Line items with a place in their order that no other has.
    "lines": """
        SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS INT) AS pos
        FROM {lineitem}""",
    # Roads: one row per line item, from the customer's nation to the supplier's.
    "roads": """
        SELECT l.l_orderkey * 100 + l.pos AS road_id, c.c_nationkey AS tail, s.s_nationkey AS head,
          CASE WHEN l.l_quantity > 3 THEN l.l_quantity END AS speed, CASE WHEN l.l_discount > 0.01 THEN l.l_extendedprice END AS length,
          l.l_linenumber - 1 AS lanes, -(l.l_linenumber % 6) AS priority, l.l_tax AS tax, l.l_partkey AS partkey
        FROM {lines} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
          JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    # A sparse directed graph over nations: of each, the nine that it trades most with.
    "pairs": """
        SELECT tail, head, weight FROM (
          SELECT c.c_nationkey AS tail, s.s_nationkey AS head, CAST(1 + SUM(l.l_orderkey) % 997 AS BIGINT) AS weight,
            row_number() OVER (PARTITION BY c.c_nationkey ORDER BY COUNT(*) DESC, s.s_nationkey) AS place
          FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
            JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
          WHERE c.c_nationkey <> s.s_nationkey GROUP BY c.c_nationkey, s.s_nationkey) x
        WHERE place <= 9""",
    # A city of customers: rows of 30 houses, streets to the next house and to the next row.
    "blocks": """
        SELECT a.c_custkey AS one, b.c_custkey AS other, CAST(1 + FLOOR(ABS(a.c_acctbal)) % 97 AS BIGINT) AS there, CAST(1 + FLOOR(ABS(b.c_acctbal)) % 89 AS BIGINT) AS back
        FROM (SELECT c_custkey, c_acctbal, c_custkey + 30 AS beside FROM {customer} UNION ALL SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 30 <> 0 THEN c_custkey + 1 END AS beside FROM {customer}) a
          JOIN {customer} b ON b.c_custkey = a.beside""",
    "streets": "SELECT one AS tail, other AS head, there AS weight FROM {blocks} UNION ALL SELECT other AS tail, one AS head, back AS weight FROM {blocks}",
    "edges": "SELECT CAST(row_number() OVER (ORDER BY tail, head) - 1 AS INT) AS edge_id, tail, head, weight FROM {pairs}",
    "places": """
        SELECT n_nationkey AS node_id, CAST(40 + (n_nationkey * 37 % 100) / 10.0 AS DOUBLE) AS lat, CAST(5 + (n_nationkey * 53 % 100) / 10.0 AS DOUBLE) AS lon,
          n_regionkey AS region FROM {nation}""",
    # Hourly travel times of 50 links, before they are made first-in-first-out.
    "hourly": """
        SELECT CAST(user_id % 50 AS INT) AS edge_id, CAST(hour(ts) * 3600000 AS BIGINT) AS at_ms, CAST(600000 + SUM(event_id * 7919) % 7000000 AS BIGINT) AS val
        FROM {events} GROUP BY user_id % 50, hour(ts)""",
    # Complete periodic functions: points at every full hour that was seen, at 0 and at the period.
    "points": """
        SELECT edge_id, at_ms, val FROM {fifo}
        UNION ALL SELECT edge_id, CAST(0 AS BIGINT) AS at_ms, first_val AS val FROM {firsts} WHERE first_at > 0
        UNION ALL SELECT edge_id, CAST(86400000 AS BIGINT) AS at_ms, first_val AS val FROM {firsts}""",
    "fifo": """
        SELECT edge_id, at_ms, val FROM (
          SELECT edge_id, at_ms, CAST(MIN(at_ms + val) OVER (PARTITION BY edge_id ORDER BY at_ms DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - at_ms AS BIGINT) AS val
          FROM (SELECT edge_id, at_ms, val FROM {hourly} UNION ALL SELECT edge_id, 86400000 + MIN(at_ms) AS at_ms, MIN_BY(val, at_ms) AS val FROM {hourly} GROUP BY edge_id) x) y
        WHERE at_ms < 86400000""",
    "firsts": "SELECT edge_id, MIN(at_ms) AS first_at, MIN_BY(val, at_ms) AS first_val FROM {fifo} GROUP BY edge_id",
    "departures": "SELECT event_id, CAST(user_id % 50 AS INT) AS edge_id, CAST(event_id * 104729 % 86400000 AS BIGINT) AS t, value FROM {events}",
    # Interval measurements: 15 minutes by link.
    "measured": """
        SELECT CAST(user_id % 50 AS INT) AS edge_id, CAST(FLOOR((hour(ts) * 60 + minute(ts)) / 15.0) * 900 AS BIGINT) AS begin_s, COUNT(*) AS vehicles,
          ROUND(SUM(value), 4) AS sampled, ROUND(AVG(value) + 1, 4) AS traveltime, ROUND(MAX(value) + 1, 4) AS overlap_tt
        FROM {events} GROUP BY user_id % 50, FLOOR((hour(ts) * 60 + minute(ts)) / 15.0)""",
    # Alternatives of a trip: the lines of an order.
    "alternatives": """
        SELECT l_orderkey AS query_id, pos - 1 AS alt_ix, l_extendedprice AS cost, 1.0 / COUNT(*) OVER (PARTITION BY l_orderkey) AS prob, l_partkey AS partkey, l_suppkey AS suppkey
        FROM {lines}""",
}
#: Small aggregates of large tables: written when first asked for, and not computed by every reader.
WRITTEN = ("edges", "hourly", "points", "measured")
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """Base and derived tables of one data directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in DERIVED:
                made = self.sql(DERIVED[name])
                self._made[name] = written(made, name) if name in WRITTEN else made
            elif name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(_NAME.findall(text))})


def duck(text: str) -> str:
    """``text`` for DuckDB, preceded by the derived tables that it names."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in DERIVED and name not in order:
            for n in _NAME.findall(DERIVED[name]):
                need(n)
            order.append(name)

    for n in _NAME.findall(text):
        need(n)
    plain = lambda s: _NAME.sub(r"\1", s)
    withs = ", ".join(f"{n} AS ({plain(DERIVED[n])})" for n in order)
    body = plain(text).strip()
    if not withs:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        recursive = rest[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{withs}, {rest[10:] if recursive else rest}"
    return f"WITH {withs} {body}"
