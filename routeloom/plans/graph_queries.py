"""Hierarchies, goal-directed servers, time-dependent searches and the workloads made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.functions import roads, ttf
from routeloom.operators import assignment, contraction, hierarchy, network, potentials, search, workloads
from routeloom.plans.queries import _ALL, _STQ, _functions, _hubs, _rounds, _timed_graph, _timed_queries
from routeloom.plans.registry import query
from routeloom.plans.tables import Tables

_DIST = f"SELECT q.query_id, q.source, q.target, CAST(d.d AS BIGINT) AS dist FROM ({_STQ}) q LEFT JOIN d5 d ON d.s = q.source AND d.v = q.target"


def _metric(t: Tables, edges: DataFrame | None = None) -> tuple[search.Graph, hierarchy.Metric]:
    graph = search.load_graph(t.edges if edges is None else edges)
    return graph, hierarchy.Hierarchy(graph, hierarchy.min_degree_order(graph)).customize()


# --- hierarchies at size: a city of customers -----------------------------------------------

#: One house of each nation, the ends of the city's queries.
_HOUSES = "SELECT min(c_custkey) AS node FROM {customer} GROUP BY c_nationkey"
#: Shortest distances from the houses by improving labels until none changes.
_CITY = f"""WITH RECURSIVE h AS ({_HOUSES}), d(s, v, d) USING KEY (s, v) AS (
  SELECT node, node, CAST(0 AS BIGINT) FROM h UNION
  SELECT n.s, n.v, n.d FROM (SELECT d.s, e.head AS v, min(d.d + e.weight) AS d FROM d JOIN {{streets}} e ON e.tail = d.v GROUP BY d.s, e.head) n
    LEFT JOIN recurring.d r ON r.s = n.s AND r.v = n.v WHERE r.d IS NULL OR n.d < r.d)"""


@query("G12_contraction", f"{_CITY} SELECT s AS source, v AS target, d AS dist FROM d")
def _(t):
    arcs, core = contraction.contract(t.streets, 100)
    found = contraction.sweep(arcs, contraction.labels(t.sql(_HOUSES), arcs, core, True))
    return found.withColumnRenamed("node", "target")


@query("G17_nearest_houses", f"{_CITY} SELECT s AS source, v AS node, d AS dist, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, v) AS k FROM d WHERE v IN (SELECT node FROM h)) x WHERE k <= 4")
def _(t):
    arcs, core = contraction.contract(t.streets, 100)
    houses = t.sql(_HOUSES)
    out, into = (contraction.labels(houses, arcs, core, forward) for forward in (True, False))
    return contraction.label_nearest(houses.withColumnRenamed("node", "source"), houses.withColumnRenamed("node", "target"), out, into, 4)


@query("G28_city_distances", f"{_CITY} SELECT s AS source, v AS node, d AS dist FROM d")
def _(t):
    return search.distances(t.streets, t.sql(_HOUSES).withColumnRenamed("node", "source"))


@query("G14_pruned_hierarchy", f"{_ALL} {_DIST}")
def _(t):
    graph = search.load_graph(t.edges)
    metric = hierarchy.Hierarchy(graph, hierarchy.min_degree_order(graph)).customize(perfect=True).pruned()
    return hierarchy.tree_distances(t.sql(_STQ), metric).select("query_id", "source", "target", "dist")


# --- servers --------------------------------------------------------------------------------


@query("G3_bidirectional", f"{_ALL} {_DIST}")
def _(t):
    def answer(g):
        back = workloads.reversed_graph(g)
        return lambda s, x: (workloads.bidirectional(g, back, s, x) if s != x else 0, 0)

    return potentials.answered(t.sql(_STQ), search.load_graph(t.edges), answer).drop("settled")


_KINDS = ("zero", "exact", "landmarks")


@query("G10_a_star", f"{_ALL} SELECT k.kind, x.* FROM ({_DIST.replace('SELECT q', 'SELECT q', 1)}) x, (VALUES ('zero'), ('exact'), ('landmarks')) k(kind)")
def _(t):
    graph = search.load_graph(t.edges)

    def by(kind):
        def answer(g):
            tables = workloads.landmark_tables(g, 3) if kind == "landmarks" else []
            bound = {"zero": lambda _: lambda _n: 0.0, "exact": lambda x: workloads.exact_bounds(g, x), "landmarks": lambda x: workloads.landmark_bound(tables, x)}[kind]
            return lambda s, x: workloads.a_star(g, s, x, bound(x))

        return potentials.answered(t.sql(_STQ), graph, answer).drop("settled").withColumn("kind", F.lit(kind))

    return by("zero").unionByName(by("exact")).unionByName(by("landmarks"))


@query("G20_nearest_of_many", f"{_ALL} SELECT s AS node, CAST(min(d) AS BIGINT) AS dist FROM d5 WHERE v IN (SELECT node_id FROM {{places}} WHERE region = 3) GROUP BY s")
def _(t):
    targets = [r["node_id"] for r in t.places.where("region = 3").select("node_id").collect()]
    return potentials.nearest_of_many(t.places.select(F.col("node_id").alias("node")), _metric(t)[1], targets).where("dist IS NOT NULL")


@query("G20_G21_potentials", f"{_ALL} {_DIST}")
def _(t):
    return potentials.with_potentials(t.sql(_STQ), *_metric(t)).drop("settled")


def _scaled(factor: str) -> str:
    return _rounds(5).replace("SELECT tail AS s, head AS v, weight AS d FROM {edges}", f"SELECT tail AS s, head AS v, CAST(floor(weight * {factor}) AS BIGINT) AS d FROM {{edges}}", 1)


def _slower(t: Tables, factor: float) -> DataFrame:
    return t.edges.withColumn("weight", F.floor(F.col("weight") * factor).cast("bigint"))


for _name, _factor in (("X7_scaled_5_percent", 1.05), ("X7_scaled_25_percent", 1.25)):

    @query(_name, f"{_scaled(str(_factor))} {_DIST}")
    def _(t, factor=_factor):
        return potentials.with_potentials(t.sql(_STQ), search.load_graph(_slower(t, factor)), _metric(t)[1]).drop("settled")


#: Live weights: the links that most events were seen on are blocked, others are ten times slower.
_JAMS = "SELECT CAST(user_id % 225 AS INT) AS edge_id, count(*) AS n, max(value) AS most FROM {events} GROUP BY user_id % 225"
_JAMMED = f"SELECT e.edge_id, e.tail, e.head, CASE WHEN j.n IS NULL THEN e.weight WHEN j.most > 90 THEN NULL ELSE e.weight * 10 END AS weight FROM {{edges}} e LEFT JOIN ({_JAMS}) j ON j.edge_id = e.edge_id"


@query("X7_X9_live_and_blocked", _rounds(5).replace("SELECT tail AS s, head AS v, weight AS d FROM {edges}", f"SELECT tail AS s, head AS v, weight AS d FROM ({_JAMMED}) j WHERE weight IS NOT NULL", 1) + f" {_DIST}")
def _(t):
    return potentials.with_potentials(t.sql(_STQ), search.load_graph(network.reachable_edges(t.sql(_JAMMED))), _metric(t)[1]).drop("settled")


_TURN_QUERIES = "SELECT c_custkey AS query_id, CAST(c_custkey % 225 AS INT) AS source, CAST(c_custkey * 7 % 225 AS INT) AS target FROM {customer}"
_TURNS = """WITH t AS (SELECT a.edge_id AS f, b.edge_id AS g, a.weight + CASE WHEN a.tail = b.head AND a.head = b.tail THEN 100 ELSE 0 END AS w FROM {edges} a JOIN {edges} b ON a.head = b.tail),
    d0 AS (SELECT f AS s, g AS v, w AS d FROM t UNION ALL SELECT edge_id, edge_id, 0 FROM {edges})"""
_TURNS += "".join(f", d{k + 1} AS (SELECT a.s, b.v, min(a.d + b.d) AS d FROM d{k} a JOIN d{k} b ON a.v = b.s GROUP BY a.s, b.v)" for k in range(4))


@query("X2_X9_turns", f"{_TURNS} SELECT q.query_id, q.source, q.target, CAST(d.d AS BIGINT) AS dist FROM ({_TURN_QUERIES}) q LEFT JOIN d4 d ON d.s = q.source AND d.v = q.target")
def _(t):
    turns = network.line_graph(t.edges, network.u_turn(100)).select(F.col("from_edge").alias("tail"), F.col("to_edge").alias("head"), "weight")
    turns = network.edge_ids(turns)
    ends = {r["edge_id"]: (r["tail"], r["head"], r["weight"]) for r in t.edges.collect()}  # checked by load_graph
    return potentials.with_turns(t.sql(_TURN_QUERIES), search.load_graph(turns), _metric(t)[1], ends).drop("settled")


@query("X8_X15_unpacked_routes", f"{_ALL} SELECT q.query_id, CAST(d.d AS BIGINT) AS dist, CAST(d.d AS BIGINT) AS path_weight FROM ({_STQ}) q LEFT JOIN d5 d ON d.s = q.source AND d.v = q.target")
def _(t):
    found = search.dijkstra(t.sql(_STQ), search.load_graph(t.edges))
    hops = found.select("query_id", F.explode_outer("edge_path").alias("edge_id")).join(t.edges.select("edge_id", "weight"), "edge_id", "left")
    length = hops.groupBy("query_id").agg(F.sum("weight").alias("w"))
    return found.join(length, "query_id").select("query_id", "dist", F.when(F.col("dist") == 0, 0).otherwise(F.col("w")).cast("bigint").alias("path_weight"))


@query("X1_G34_servers_agree", f"{_ALL}, q AS (SELECT query_id, source, target FROM ({_STQ}) x ORDER BY query_id LIMIT 100) SELECT k.server, q.query_id, CAST(d.d AS BIGINT) AS dist FROM q LEFT JOIN d5 d ON d.s = q.source AND d.v = q.target, (VALUES ('dijkstra'), ('bidirectional'), ('potentials'), ('tree'), ('labels')) k(server)")
def _(t):
    q = t.sql(_STQ).orderBy("query_id").limit(100)
    graph, metric = _metric(t)

    def both(g):
        back = workloads.reversed_graph(g)
        return lambda s, x: (workloads.bidirectional(g, back, s, x) if s != x else 0, 0)

    out, into = _hubs(t)
    labels = search.label_distances(q.select("source", "target").distinct(), out, into).select("source", "target", "dist")
    found = {
        "dijkstra": search.dijkstra(q, graph),
        "bidirectional": potentials.answered(q, graph, both),
        "potentials": potentials.with_potentials(q, graph, metric),
        "tree": hierarchy.tree_distances(q, metric),
        "labels": q.join(labels, ["source", "target"], "left"),
    }
    each = [df.select(F.lit(k).alias("server"), "query_id", "dist") for k, df in found.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).unionByName(each[4])


@query("X6_X14_search_spaces", f"{_ALL}, q AS (SELECT DISTINCT source, target FROM ({_STQ}) x) SELECT q.source, q.target, count(*) AS settled, CAST(max(n.d) AS BIGINT) AS radius FROM q JOIN d5 t ON t.s = q.source AND t.v = q.target JOIN d5 n ON n.s = q.source AND (n.d, n.v) <= (t.d, t.v) GROUP BY q.source, q.target")
def _(t):
    dist = search.relax(t.edges, t.places.select(F.col("node_id").alias("source")))
    return workloads.search_spaces(t.sql(_STQ).select("source", "target").distinct(), dist)


@query("X12_one_to_many", f"{_ALL} SELECT s AS source, v AS target, CAST(d AS BIGINT) AS dist FROM d5 WHERE v IN (SELECT node_id FROM {{places}} WHERE region = 1)")
def _(t):
    targets = t.places.where("region = 1").select(F.col("node_id").alias("target"))
    q = t.places.select(F.col("node_id").alias("source")).join(F.broadcast(targets)).orderBy("target")  # targets: a region's few
    return potentials.with_potentials(q, *_metric(t)).where("dist IS NOT NULL").select("source", "target", "dist")


@query("X16_nearest_by_labels", f"{_ALL} SELECT s AS source, v AS node, CAST(d AS BIGINT) AS dist, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, v) AS k FROM d5 WHERE v IN (SELECT node_id FROM {{places}} WHERE region > 1)) x WHERE k <= 4")
def _(t):
    out, into = _hubs(t)
    n = t.places
    return contraction.label_nearest(n.select(F.col("node_id").alias("source")), n.where("region > 1").select(F.col("node_id").alias("target")), out, into, 4)


# --- time-dependent searches ----------------------------------------------------------------

_ROUNDS = 14
#: Segments of each edge's function, and earliest arrivals after up to so many edges.
_TD = """WITH seg AS (SELECT e.edge_id, e.tail, e.head, p.at_ms AS a, p.val AS v, lead(p.at_ms) OVER w AS b, lead(p.val) OVER w AS u FROM {edges} e JOIN {points} p ON p.edge_id = e.edge_id % 50 WINDOW w AS (PARTITION BY e.edge_id ORDER BY p.at_ms)),
    q AS (SELECT c_custkey AS query_id, c_nationkey AS source, CAST(c_custkey * 7 % 25 AS INT) AS target, CAST(c_custkey * 104729 % 86400000 AS BIGINT) AS departure FROM {customer}),
    r0 AS (SELECT query_id, source AS node, departure AS t FROM q)"""
_STEP = "a.t + s.a + s.v + (a.t % 86400000 - s.a) * (s.b + s.u - s.a - s.v) // (s.b - s.a) - a.t % 86400000"
_TD += "".join(
    f""", r{k + 1} AS MATERIALIZED (SELECT query_id, node, min(t) AS t FROM (SELECT query_id, node, t FROM r{k}
      UNION ALL SELECT a.query_id, s.head, {_STEP} FROM r{k} a JOIN seg s ON s.tail = a.node AND a.t % 86400000 >= s.a AND a.t % 86400000 < s.b) x GROUP BY query_id, node)"""
    for k in range(_ROUNDS)
)


@query("G5_X4_td_distances", f"{_TD} SELECT q.query_id, q.source, q.target, q.departure, CAST(r.t - q.departure AS BIGINT) AS dist FROM q LEFT JOIN r{_ROUNDS} r ON r.query_id = q.query_id AND r.node = q.target")
def _(t):
    return search.td_dijkstra(_timed_queries(t), _timed_graph(t)).select("query_id", "source", "target", "departure", "dist")


@query("G21_G25_X10_X17_td_potentials", f"{_TD} SELECT q.query_id, q.source, q.target, q.departure, CAST(r.t - q.departure AS BIGINT) AS dist FROM q LEFT JOIN r{_ROUNDS} r ON r.query_id = q.query_id AND r.node = q.target")
def _(t):
    least = t.points.groupBy((F.col("edge_id")).alias("f_id")).agg(F.min("val").alias("weight"))
    lower = t.edges.withColumn("f_id", F.col("edge_id") % 50).drop("weight").join(least, "f_id").select("edge_id", "tail", "head", "weight")
    return potentials.with_potentials(_timed_queries(t), _timed_graph(t), _metric(t, lower)[1]).drop("settled")


_TDS = _TD.replace("p.at_ms AS a, p.val AS v, lead(p.at_ms) OVER w AS b, lead(p.val) OVER w AS u", "p.at_ms / 1000.0::DOUBLE AS a, p.val / 1000.0::DOUBLE AS v, lead(p.at_ms / 1000.0::DOUBLE) OVER w AS b, lead(p.val / 1000.0::DOUBLE) OVER w AS u")
_TDS = _TDS.replace("CAST(c_custkey * 104729 % 86400000 AS BIGINT) AS departure", "(c_custkey * 104729 % 86400000) / 1000.0::DOUBLE AS departure").replace(_STEP, "a.t + s.v + (a.t % 86400.0 - s.a) * (s.u - s.v) / (s.b - s.a)").replace("86400000 >= s.a", "86400.0 >= s.a").replace("86400000 < s.b", "86400.0 < s.b")


@query(
    "G6_td_ranks",
    f"""{_TDS} SELECT q.query_id, q.source, q.target, CAST(round(r.t - q.departure, 4) AS DOUBLE) AS dist, (SELECT count(*) FROM r{_ROUNDS} n WHERE n.query_id = q.query_id AND (n.t, n.node) <= (r.t, r.node)) AS settled
    FROM q JOIN r{_ROUNDS} r ON r.query_id = q.query_id AND r.node = q.target""",
)
def _(t):
    q = t.sql(_STQ).withColumn("departure", F.pmod(F.col("query_id") * 104729, F.lit(86_400_000)) / 1000)
    timed = t.edges.select((F.col("edge_id") % 50).cast("int").alias("f_id"), "edge_id").join(t.points.withColumnRenamed("edge_id", "f_id"), "f_id").select("edge_id", (F.col("at_ms") / 1000).alias("at"), (F.col("val") / 1000).alias("val"))
    found = potentials.td_with_ranks(q, search.load_graph(t.edges, timed), 86_400.0)
    return found.where("dist IS NOT NULL").select("query_id", "source", "target", F.round("dist", 4).alias("dist"), "settled")


# --- views, sets and formulas ---------------------------------------------------------------


@query("P18_reachable_edges", f"SELECT edge_id, tail, head, weight FROM ({_JAMMED}) j WHERE weight IS NOT NULL")
def _(t):
    return network.reachable_edges(t.sql(_JAMMED))


@query("P29_tails", "SELECT CAST(edge_id AS BIGINT) AS edge_id, tail FROM {edges}")
def _(t):
    return network.tails(network.csr(t.edges, t.places))


@query("J17_alternative_pairs", "SELECT a.query_id, a.alt_ix AS first, b.alt_ix AS second, CAST((a.partkey = b.partkey)::INT + (a.suppkey = b.suppkey)::INT AS INT) AS shared FROM {alternatives} a JOIN {alternatives} b ON a.query_id = b.query_id AND a.alt_ix < b.alt_ix")
def _(t):
    return workloads.alternative_pairs(t.alternatives.select("query_id", "alt_ix", F.array(F.concat(F.lit("p"), "partkey"), F.concat(F.lit("s"), "suppkey")).alias("path")))


@query("U4_remaining", "SELECT o_orderkey FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45")
def _(t):
    drawn = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return network.unmatched(t.orders.select("o_orderkey"), drawn, ["o_orderkey"])


@query("N3_fifo_up", "SELECT edge_id, at_ms AS at, CAST(max(at_ms + val) OVER (PARTITION BY edge_id ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - at_ms AS BIGINT) AS val FROM {hourly}")
def _(t):
    f = t.hourly.groupBy("edge_id").agg(ttf.collect("at_ms").alias("f"))
    return f.select("edge_id", F.explode(ttf.fifo_up(F.col("f"))).alias("p")).select("edge_id", "p.at", "p.val")


_END = "CAST({0} AS DOUBLE)"


@query(
    "F34_crossings",
    """WITH x AS (SELECT a.edge_id AS first, b.edge_id AS second, p.lon AS ax, p.lat AS ay, q.lon AS bx, q.lat AS by_, r.lon AS cx, r.lat AS cy, s.lon AS dx, s.lat AS dy
      FROM {edges} a JOIN {edges} b ON a.tail = b.tail + 1 AND a.edge_id <> b.edge_id JOIN {places} p ON p.node_id = a.tail JOIN {places} q ON q.node_id = a.head JOIN {places} r ON r.node_id = b.tail JOIN {places} s ON s.node_id = b.head),
    y AS (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS det, (cx - ax) * (dy - cy) - (cy - ay) * (dx - cx) AS n1, (cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax) AS n2, (bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay) AS turn FROM x)
    SELECT first, second, turn > 1e-9 AS left_turn, CAST(CASE WHEN abs(det) > 1e-9 AND n1 / det BETWEEN 0 AND 1 AND n2 / det BETWEEN 0 AND 1 THEN round(ax + n1 / det * (bx - ax), 6) END AS DOUBLE) AS x,
      CAST(CASE WHEN abs(det) > 1e-9 AND n1 / det BETWEEN 0 AND 1 AND n2 / det BETWEEN 0 AND 1 THEN round(ay + n1 / det * (by_ - ay), 6) END AS DOUBLE) AS y FROM y""",
)
def _(t):
    at = lambda name, x, y: t.places.select(F.col("node_id").alias(name), F.col("lon").alias(x), F.col("lat").alias(y))
    a = t.edges.select(F.col("edge_id").alias("first"), F.col("tail").alias("t1"), F.col("head").alias("h1")).join(at("t1", "ax", "ay"), "t1").join(at("h1", "bx", "by"), "h1")
    b = t.edges.select(F.col("edge_id").alias("second"), F.col("tail").alias("t2"), F.col("head").alias("h2")).join(at("t2", "cx", "cy"), "t2").join(at("h2", "dx", "dy"), "h2")
    both = a.join(b, (F.col("t1") == F.col("t2") + 1) & (F.col("first") != F.col("second")))
    c = {n: F.col(n) for n in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")}
    point = roads.crossing(**c)
    left = roads.counter_clockwise(c["ax"], c["ay"], c["bx"], c["by"], c["cx"], c["cy"])
    return both.select("first", "second", left.alias("left_turn"), point.alias("p")).select("first", "second", "left_turn", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("F8_cropped", "SELECT edge_id, at_ms / 1000.0::DOUBLE AS at, val / 1000.0::DOUBLE AS val FROM {points} WHERE at_ms BETWEEN 21600000 AND 64800000 AND edge_id IN (SELECT edge_id FROM {points} WHERE at_ms IN (21600000, 64800000) GROUP BY edge_id HAVING count(*) = 2)")
def _(t):
    p = t.points.select("edge_id", (F.col("at_ms") / 1000).alias("at"), (F.col("val") / 1000).alias("val")).groupBy("edge_id").agg(ttf.collect().alias("f"))
    whole = p.where(F.exists("f", lambda x: x["at"] == 21_600.0) & F.exists("f", lambda x: x["at"] == 64_800.0))
    return whole.select("edge_id", F.explode(ttf.crop(F.col("f"), F.lit(21_600.0), F.lit(64_800.0))).alias("p")).select("edge_id", "p.at", "p.val")


@query(
    "F12_N2_updated",
    """WITH u AS (SELECT edge_id, at_ms, CASE WHEN at_ms % 7200000 = 0 AND at_ms < 86400000 THEN val + 900000 ELSE val END AS val FROM {points}),
    w AS (SELECT edge_id, at_ms, CASE WHEN at_ms = max(at_ms) OVER (PARTITION BY edge_id) THEN first_value(val) OVER (PARTITION BY edge_id ORDER BY at_ms) ELSE val END AS val FROM u)
    SELECT edge_id, at_ms AS at, CAST(min(at_ms + val) OVER (PARTITION BY edge_id ORDER BY at_ms DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - at_ms AS BIGINT) AS val FROM w""",
)
def _(t):
    late = t.points.where("at_ms % 7200000 = 0 AND at_ms < 86400000").select("edge_id", F.col("at_ms").alias("at"), (F.col("val") + 900_000).alias("val"))
    found = workloads.set_at(_functions(t), late)
    return found.select("edge_id", F.explode("f").alias("p")).select("edge_id", "p.at", "p.val")


@query("X20_live_durations", "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(value * 1000 AS BIGINT) AS duration FROM {events} WHERE value > 50")
def _(t):
    return t.events.where("value > 50").select("event_id", (F.col("value") * 1000).cast("decimal(30,6)").alias("d")).select("event_id", F.round("d", 0).cast("bigint").alias("duration"))


@query("X24_unit_weights", "SELECT CAST(edge_id AS BIGINT) AS i, CAST(1 AS BIGINT) AS value FROM {edges}")
def _(t):
    return t.edges.select(F.col("edge_id").cast("bigint").alias("i"), F.lit(1).cast("bigint").alias("value"))


@query("X25_alternative_costs", "SELECT query_id || ' ' || alt_ix || ' ' || printf('%.2f', cost) AS value FROM {alternatives}")
def _(t):
    return t.alternatives.select(F.format_string("%d %d %.2f", "query_id", "alt_ix", F.col("cost").cast("double")).alias("value"))


_RUN_TABLE = "SELECT o_orderstatus AS algorithm, c_nationkey AS instance, o_custkey % 3 AS repetition, o_totalprice AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


@query("X27_by_repetition", f"SELECT algorithm, instance, repetition, round(avg(CAST(value AS DOUBLE)), 7) AS mean, count(*) AS runs FROM ({_RUN_TABLE}) r GROUP BY ALL")
def _(t):
    return t.sql(_RUN_TABLE).groupBy("algorithm", "instance", "repetition").agg(F.round(F.avg(F.col("value").cast("double")), 7).alias("mean"), F.count(F.lit(1)).alias("runs"))


@query("X28_best_runs", f"WITH m AS (SELECT algorithm, instance, repetition, sum(value) AS total FROM ({_RUN_TABLE}) r GROUP BY ALL), b AS (SELECT algorithm, instance, arg_min(repetition, (total, repetition)) AS repetition, min(total) AS total FROM m GROUP BY ALL) SELECT algorithm, instance, repetition, CAST(round(total, 2) AS DOUBLE) AS total, CAST(round(median(CAST(total AS DOUBLE)) OVER (PARTITION BY algorithm), 2) AS DOUBLE) AS median FROM b")
def _(t):
    from routeloom.operators import analysis

    m = t.sql(_RUN_TABLE).groupBy("algorithm", "instance", "repetition").agg(F.sum("value").alias("total"))
    best = analysis.best_runs(m, ["algorithm", "instance"], "repetition", "total")
    middle = best.groupBy("algorithm").agg(F.round(F.median(F.col("total").cast("double")), 2).alias("median"))
    return best.join(middle, "algorithm").select("algorithm", "instance", "repetition", F.round(F.col("total").cast("double"), 2).alias("total"), "median")


# --- assignment -----------------------------------------------------------------------------


def _route(trips: DataFrame, weights: DataFrame) -> DataFrame:
    found = search.dijkstra(trips, search.load_graph(weights))
    return found.where("dist IS NOT NULL AND size(edge_path) > 0").select("query_id", F.col("edge_path").alias("path"), F.col("dist").cast("double").alias("cost"))


def _route_guided(trips: DataFrame, weights: DataFrame) -> DataFrame:
    """As ``_route``, but answered by a search from both ends' labels for the cost."""
    graph = search.load_graph(weights)
    metric = hierarchy.Hierarchy(graph, hierarchy.min_degree_order(graph)).customize()
    return potentials.with_potentials(trips, graph, metric).where("dist > 0").select("query_id", F.col("dist").cast("double").alias("cost"))


def _adjust(weights: DataFrame, old: DataFrame | None, new: DataFrame) -> DataFrame:
    """An edge gets slower by one for four vehicles more, and faster for those that leave it."""
    use = new.select(F.explode("path").alias("e"), F.lit(1).alias("n"))
    if old is not None:
        use = use.unionByName(old.select(F.explode("path").alias("e"), F.lit(-1).alias("n")))
    per = use.groupBy("e").agg(F.sum("n").alias("n"))
    slower = F.greatest(F.lit(1), F.col("weight") + F.floor(F.coalesce("n", F.lit(0)) / 4)).cast("bigint")
    return weights.join(per, weights["edge_id"] == per["e"], "left").select("edge_id", "tail", "head", slower.alias("weight"))


def _along(found: DataFrame, weights: DataFrame) -> DataFrame:
    hops = found.select("query_id", F.posexplode("path").alias("k", "edge_id")).join(weights.select("edge_id", "weight"), "edge_id")
    return hops.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "edge_id"))), lambda x: x["edge_id"]).alias("path"), F.sum("weight").cast("double").alias("cost"))


@query("D9_two_stage")
def _(t):
    alternatives, _, _ = assignment.two_stage(t.sql(_STQ), t.edges, 2, _route, _adjust, _along)
    return alternatives.select("query_id", "alt_ix", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.round("cost", 4).alias("cost"), F.round("prob", 6).alias("prob"))


@query("D8_D10_routers", f"{_ALL} SELECT k.router, q.query_id, CAST(d.d AS DOUBLE) AS cost FROM ({_STQ}) q JOIN d5 d ON d.s = q.source AND d.v = q.target AND d.d > 0, (VALUES ('dijkstra'), ('guided')) k(router)")
def _(t):
    a = _route(t.sql(_STQ), t.edges).select(F.lit("dijkstra").alias("router"), "query_id", "cost")
    return a.unionByName(_route_guided(t.sql(_STQ), t.edges).select(F.lit("guided").alias("router"), "query_id", "cost"))


@query("D12_iteration_gaps", "SELECT l_linenumber AS iteration, CAST(round(sum(CASE WHEN abs(c - b) < 1 OR c < b THEN 0 ELSE c - b END) / sum(b), 9) AS DOUBLE) AS gap, count(*) AS trips FROM (SELECT l_linenumber, l_extendedprice::DOUBLE AS c, l_extendedprice::DOUBLE - (l_orderkey % 50 - 10) AS b FROM {lines}) x GROUP BY l_linenumber")
def _(t):
    trip = F.concat_ws("-", "l_orderkey", "pos").alias("query_id")
    driven = t.lines.select(F.col("l_linenumber").alias("iteration"), trip, F.col("l_extendedprice").cast("double").alias("cost"))
    best = t.lines.select(F.col("l_linenumber").alias("iteration"), trip, (F.col("l_extendedprice").cast("double") - (F.col("l_orderkey") % 50 - 10)).alias("cost"))
    return assignment.iteration_gaps(driven, best).select("iteration", F.round("gap", 9).alias("gap"), "trips")
