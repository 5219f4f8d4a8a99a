"""Queries over the road tables, each with the same result in SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import kernels, roads, ttf
from routeloom.operators import analysis, assignment, hierarchy, measurements, network, routing, search, workloads
from routeloom.operators.tables import if_small
from routeloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from routeloom.plans.tables import Tables
from routeloom.sources import formats
from routeloom.streaming import link_speed

INTERVAL = 900


def _functions(t: Tables) -> DataFrame:
    return t.points.groupBy("edge_id").agg(ttf.collect("at_ms").alias("f"))


#: Functions, of some kB each, that are broadcast at most.
FUNCTIONS = 20_000


def _small_functions(t: Tables) -> DataFrame:
    """All functions, broadcast where they are few."""
    return if_small(_functions(t), FUNCTIONS)


def _draw(*parts) -> str:
    """A draw of ``functions.chance`` in SQL; numbers are seeds."""
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(f"'{p}'" if isinstance(p, int) else p for p in parts) + "), 1, 12) AS BIGINT)"


_U = f"{float(1 << 48):.1f}::DOUBLE"


# --- projections, filters, ids -------------------------------------------------------------


@query(
    "P1_P2_edge_weights",
    "SELECT road_id, tail, head, CAST(trunc(greatest(coalesce(length, 100.0 + tail) / coalesce(speed, 13.9), 0.0) * 1000) AS BIGINT) AS weight FROM {roads}",
)
def _(t):
    r = t.roads.withColumn("length", F.coalesce("length", 100.0 + F.col("tail")))
    return network.weigh(r).select("road_id", "tail", "head", "weight")


_STEPS = "CASE " + " ".join(
    f"WHEN {cond} THEN CASE {' '.join(f'WHEN v <= {s} THEN {c}' for s, c in steps[:-1] if True)} ELSE {steps[-1][1]} END" if len(steps) > 1 else f"WHEN {cond} THEN {steps[-1][1]}"
    for cond, steps in (("rc IN (0, 1)", roads.LANE_CAPACITY[1]), ("rc = 2", roads.LANE_CAPACITY[2]), ("rc = 3", roads.LANE_CAPACITY[3]), ("TRUE", roads.LANE_CAPACITY[4]))
)


@query(
    "P3_capacity",
    f"""SELECT road_id, CAST(ROUND(CASE WHEN lanes = 0 THEN 0.0 WHEN partkey % 7 = 0 THEN tax * 10000 ELSE lanes * ({_STEPS} END) END, 4) AS DOUBLE) AS capacity
    FROM (SELECT *, -priority AS rc, coalesce(speed, 13.9) AS v FROM {{roads}}) x""",
)
def _(t):
    given = F.when(F.col("partkey") % 7 == 0, (F.col("tax") * 10000).cast("string")).otherwise(F.lit("no number"))
    return t.roads.select("road_id", F.round(roads.capacity(F.col("lanes"), F.col("priority"), F.col("speed"), given), 4).alias("capacity"))


@query("P5_edge_ids", "SELECT tail, head, CAST(row_number() OVER (ORDER BY tail, head) - 1 AS BIGINT) AS edge_id, weight FROM {pairs}")
def _(t):
    return network.dense_ids(t.pairs, ["tail", "head"], "edge_id").select("tail", "head", F.col("edge_id").cast("bigint").alias("edge_id"), "weight")


_TRIPS = "SELECT o.o_orderkey AS trip_id, CAST(o.o_orderkey % 25 AS INT) AS from_edge, CAST(o.o_custkey % 40 AS INT) AS to_edge, CAST(floor(o.o_totalprice) AS BIGINT) % 86400 AS depart FROM {orders} o"


@query(
    "P6_J2_trip_queries",
    f"""SELECT t.trip_id, a.head AS source, b.tail AS target, CAST(t.depart * 1000 AS BIGINT) AS departure
    FROM ({_TRIPS}) t JOIN {{edges}} a ON a.edge_id = t.from_edge JOIN {{edges}} b ON b.edge_id = t.to_edge""",
)
def _(t):
    return network.trip_queries(t.sql(_TRIPS), t.edges)


@query("J1_unmatched_trips", f"SELECT t.trip_id FROM ({_TRIPS}) t WHERE NOT EXISTS (SELECT 1 FROM {{edges}} e WHERE e.edge_id = t.to_edge)")
def _(t):
    return network.unmatched(t.sql(_TRIPS).withColumn("edge_id", F.col("to_edge")), t.edges.select("edge_id"), ["edge_id"]).select("trip_id")


@query(
    "P32_valid_trips",
    f"""SELECT t.trip_id, t.from_edge, t.to_edge, t.depart FROM ({_TRIPS}) t WHERE t.depart >= 3600 AND t.depart < 80000
    AND t.from_edge IN (SELECT edge_id FROM {{edges}} WHERE weight > 100) AND t.to_edge IN (SELECT edge_id FROM {{edges}} WHERE weight > 100)""",
)
def _(t):
    return network.valid_trips(t.sql(_TRIPS), t.edges.where("weight > 100"), 3600, 80000).select("trip_id", "from_edge", "to_edge", "depart")


@query(
    "P7_P8_node_expansion",
    """WITH r AS (SELECT CAST(edge_id AS VARCHAR) AS id, CAST(tail AS VARCHAR) AS f, CAST(head AS VARCHAR) AS t, weight FROM {edges})
    SELECT id, f || '"' || id AS tail, t || '"' || id AS head, weight FROM r
    UNION ALL SELECT a.id || '$$' || b.id, a.t || '"' || a.id, b.f || '"' || b.id, CAST(0 AS BIGINT) FROM r a JOIN r b ON a.t = b.f WHERE (CAST(a.id AS INT) + CAST(b.id AS INT)) % 3 > 0""",
)
def _(t):
    e = t.edges.select(*[F.col(a).cast("string").alias(b) for a, b in (("edge_id", "id"), ("tail", "from"), ("head", "to"))], "weight")
    c = network.complete_connections(t.edges).where((F.col("from_edge") + F.col("to_edge")) % 3 > 0)
    c = c.select(F.col("from_edge").cast("string").alias("from"), F.col("to_edge").cast("string").alias("to"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("fromLane"))
    return network.expand_connections(e, c)


@query("P9_dense_ids", "SELECT c_custkey AS ext_id, CAST(row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS BIGINT) AS id FROM {customer} WHERE c_acctbal > 0")
def _(t):
    rows = network.dense_ids(t.customer.where("c_acctbal > 0").select("c_custkey", "c_name"), ["c_name", "c_custkey"], "id")
    return rows.select(F.col("c_custkey").alias("ext_id"), F.col("id").cast("bigint").alias("id"))


_LINKS = """SELECT p_partkey AS link_id, CAST(p_partkey % 25 AS INT) AS ref_node, CAST(p_size % 25 AS INT) AS nonref_node,
    CASE p_size % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'F' ELSE 'T' END AS direction, CAST(p_size % 8 + 1 AS INT) AS category,
    CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS DOUBLE) END AS speed_limit, p_retailprice AS length FROM {part}"""


@query(
    "P11_P12_P13_import_links",
    f"""WITH l AS ({_LINKS}), d AS (SELECT *, unnest(CASE WHEN direction = 'B' THEN ['F', 'T'] ELSE [direction] END) AS way FROM l),
    s AS (SELECT *, least(CASE category WHEN 1 THEN 36.0 WHEN 2 THEN 30.0 WHEN 3 THEN 25.0 WHEN 4 THEN 20.0 WHEN 5 THEN 15.0 WHEN 6 THEN 10.0 WHEN 7 THEN 5.0 ELSE 2.0 END, coalesce(speed_limit, 999.0) / 3.6) AS v FROM d)
    SELECT link_id, way, CASE WHEN way = 'F' THEN ref_node ELSE nonref_node END AS tail, CASE WHEN way = 'F' THEN nonref_node ELSE ref_node END AS head,
      CAST(round(1000 * length / v) AS BIGINT) AS weight FROM s WHERE ref_node IN (SELECT node_id FROM {{places}} WHERE lat < 48) AND nonref_node IN (SELECT node_id FROM {{places}} WHERE lat < 48)""",
)
def _(t):
    speeds = {1: 36.0, 2: 30.0, 3: 25.0, 4: 20.0, 5: 15.0, 6: 10.0, 7: 5.0, 8: 2.0}
    inside = t.places.where("lat < 48").select("node_id")
    links = t.sql(_LINKS)
    links = links.join(inside, links["ref_node"] == inside["node_id"], "left_semi").join(inside, links["nonref_node"] == inside["node_id"], "left_semi")
    v = roads.category_speed(F.col("category"), F.col("speed_limit"), speeds)
    return network.directed_links(links).select("link_id", "way", "tail", "head", F.round(1000 * F.col("length") / v).cast("bigint").alias("weight"))


_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("P15_geo_distance", f"SELECT e.edge_id, CAST(round({_HAV.format(a='a', b='b').replace('{', '').replace('}', '')}, 2) AS DOUBLE) AS metres FROM {{edges}} e JOIN {{places}} a ON a.node_id = e.tail JOIN {{places}} b ON b.node_id = e.head")
def _(t):
    a, b = t.places.alias("a"), t.places.alias("b")
    j = t.edges.join(a, F.col("tail") == F.col("a.node_id")).join(b, F.col("head") == F.col("b.node_id"))
    return j.select("edge_id", F.round(roads.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 2).alias("metres"))


@query(
    "P14_N14_link_length",
    f"""WITH g AS (SELECT l_orderkey AS link_id, pos AS seq, 48 + l_discount AS lat, 9 + l_tax AS lon FROM {{lines}}),
    d AS (SELECT b.link_id, {_HAV.format(a="a", b="b").replace("{", "").replace("}", "")} AS d FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY seq) AS k FROM g) b
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY seq) AS k FROM g) a ON a.link_id = b.link_id AND a.k = b.k - 1)
    SELECT link_id, CAST(round(coalesce(sum(d), 0), 2) AS DOUBLE) AS length_m FROM d GROUP BY link_id""",
)
def _(t):
    g = t.lines.select(F.col("l_orderkey").alias("link_id"), F.col("pos").alias("seq"), (48 + F.col("l_discount")).alias("lat"), (9 + F.col("l_tax")).alias("lon"))
    return network.link_lengths(g).select("link_id", F.round("length_m", 2).alias("length_m"))


@query("P16_live_travel_time", "SELECT event_id, CASE WHEN CAST(value AS BIGINT) > 0 THEN (event_id % 5000 * 3600) // CAST(floor(value) AS BIGINT) END AS tt FROM (SELECT event_id, floor(value) AS value FROM {events}) e")
def _(t):
    return t.events.select("event_id", roads.live_travel_time(F.col("event_id") % 5000, F.floor("value")).alias("tt"))


@query(
    "P17_bounding_box",
    """WITH n AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node FROM {places} WHERE lat BETWEEN 41 AND 48 AND lon BETWEEN 6 AND 14)
    SELECT CAST(a.node AS BIGINT) AS tail, CAST(b.node AS BIGINT) AS head, e.edge_id, e.weight FROM {edges} e JOIN n a ON a.node_id = e.tail JOIN n b ON b.node_id = e.head""",
)
def _(t):
    e = network.bounding_box(t.edges, t.places, (41, 48), (6, 14))[1]
    return e.select(F.col("tail").cast("bigint").alias("tail"), F.col("head").cast("bigint").alias("head"), "edge_id", "weight")


_ROADW = "SELECT road_id, tail, head, CAST(trunc(greatest(coalesce(length, 100.0 + tail) / coalesce(speed, 13.9), 0.0) * 1000) AS BIGINT) AS weight FROM {roads}"


def _weighed(t: Tables) -> DataFrame:
    return network.weigh(t.roads.withColumn("length", F.coalesce("length", 100.0 + F.col("tail")))).select("road_id", "tail", "head", "weight")


@query("P19_simple_edges", f"SELECT tail, head, min(weight) AS weight FROM ({_ROADW}) x WHERE tail <> head GROUP BY tail, head")
def _(t):
    return network.simple_edges(_weighed(t))


@query("P20_unify_parallel", f"SELECT road_id, min(weight) OVER (PARTITION BY tail, head) AS weight FROM ({_ROADW}) x")
def _(t):
    # One pair may hold many roads: the group's least is joined back, so that no window holds it.
    r = _weighed(t)
    return r.join(r.groupBy("tail", "head").agg(F.min("weight").alias("least")), ["tail", "head"]).select("road_id", F.col("least").alias("weight"))


@query("P21_reverse", "SELECT edge_id, head AS tail, tail AS head, weight FROM {edges}")
def _(t):
    return network.reverse(t.edges).select("edge_id", "tail", "head", "weight")


_ORDER = "SELECT node_id, CAST(row_number() OVER (ORDER BY node_id * 7 % 25, node_id) - 1 AS BIGINT) AS rank FROM {places}"


@query("P22_permute", f"WITH o AS ({_ORDER}) SELECT a.rank AS tail, b.rank AS head, e.edge_id, e.weight FROM {{edges}} e JOIN o a ON a.node_id = e.tail JOIN o b ON b.node_id = e.head")
def _(t):
    return network.permute(t.edges, t.sql(_ORDER))


@query(
    "P23_rank_split",
    f"WITH o AS ({_ORDER}) SELECT e.edge_id, a.rank < b.rank AS up, least(a.rank, b.rank) AS low, greatest(a.rank, b.rank) AS high, e.weight FROM {{edges}} e JOIN o a ON a.node_id = e.tail JOIN o b ON b.node_id = e.head",
)
def _(t):
    return network.split_by_rank(network.permute(t.edges, t.sql(_ORDER))).select("edge_id", "up", "low", "high", "weight")


@query(
    "P24_P25_line_graph",
    """SELECT a.edge_id AS from_edge, b.edge_id AS to_edge, a.weight + CASE WHEN a.tail = b.head AND a.head = b.tail THEN 100 ELSE 0 END AS weight
    FROM {edges} a JOIN {edges} b ON a.head = b.tail WHERE (a.edge_id * 31 + b.edge_id) % 11 <> 0""",
)
def _(t):
    e = t.edges
    forbidden = network.complete_connections(e).where((F.col("from_edge") * 31 + F.col("to_edge")) % 11 == 0).select("from_edge", "to_edge")
    return network.line_graph(e, network.u_turn(100), forbidden)


_LIVE = "SELECT CAST(user_id % 225 AS INT) AS edge_id, CAST(floor(max(value)) AS BIGINT) + 1 AS live FROM {events} WHERE user_id % 3 = 0 GROUP BY user_id % 225"


@query("P26_live_weights", f"SELECT e.edge_id, e.tail, e.head, coalesce(l.live, e.weight) AS weight FROM {{edges}} e LEFT JOIN ({_LIVE}) l ON l.edge_id = e.edge_id")
def _(t):
    return network.with_live(t.edges, t.sql(_LIVE)).select("edge_id", "tail", "head", "weight")


@query("P27_P28_scaled_weights", f"SELECT edge_id, tail, head, CASE WHEN {_draw('edge_id', 17)} / {_U} < 0.4 THEN CAST(trunc(weight * 1.25) AS BIGINT) ELSE weight END AS weight FROM {{edges}}")
def _(t):
    return network.scaled(t.edges, 1.25, 0.4, 17)


@query("P34_slow_live", f"SELECT l.edge_id, l.live FROM ({_LIVE}) l JOIN {{edges}} e ON e.edge_id = l.edge_id WHERE l.live >= e.weight")
def _(t):
    return t.sql(_LIVE).join(t.edges, "edge_id").where("live >= weight").select("edge_id", "live")


@query(
    "P33_varying_profiles",
    """WITH p AS (SELECT tail, head, max(road_id) AS position FROM {roads} GROUP BY tail, head, priority),
    v AS (SELECT r.tail, r.head, r.priority, max(r.road_id) AS position, list(r.lanes ORDER BY r.road_id)[1:4] AS speeds, count(DISTINCT r.lanes) AS n FROM {roads} r GROUP BY ALL)
    SELECT tail, head, array_to_string(arg_max(speeds[2:4], position), ',') AS speeds FROM v WHERE len(list_distinct(speeds)) > 1 GROUP BY tail, head""",
)
def _(t):
    lanes = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("road_id", "lanes"))), 1, 4), lambda x: x["lanes"])
    p = t.roads.groupBy("tail", "head", "priority").agg(lanes.alias("speeds"), F.max("road_id").alias("position"))
    return network.varying_profiles(p, 1, 4).select("tail", "head", F.array_join("speeds", ",").alias("speeds"))


# Hourly totals of all roads: a group has 24 hours at most, however many roads it has.
@query(
    "P33_whole_profiles",
    """WITH h AS (SELECT tail, head, priority, road_id % 24 AS hour, CAST(sum(lanes) AS BIGINT) AS lanes, max(road_id) AS position FROM {roads} GROUP BY ALL),
    v AS (SELECT tail, head, priority, list(lanes ORDER BY hour) AS speeds, max(position) AS position FROM h GROUP BY ALL)
    SELECT tail, head, array_to_string(arg_max(speeds[2:4], position), ',') AS speeds FROM v WHERE len(list_distinct(speeds)) > 1 GROUP BY tail, head""",
)
def whole_profiles(t):
    h = t.roads.groupBy("tail", "head", "priority", (F.col("road_id") % 24).alias("hour")).agg(F.sum("lanes").alias("lanes"), F.max("road_id").alias("position"))
    lanes = F.transform(F.sort_array(F.collect_list(F.struct("hour", "lanes"))), lambda x: x["lanes"])
    p = h.groupBy("tail", "head", "priority").agg(lanes.alias("speeds"), F.max("position").alias("position"))
    return network.varying_profiles(p, 1, 4).select("tail", "head", F.array_join("speeds", ",").alias("speeds"))


@query("A8_csr", "SELECT n.node_id, count(e.edge_id) AS degree, CAST(coalesce(sum(count(e.edge_id)) OVER (ORDER BY n.node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_out FROM {places} n LEFT JOIN {edges} e ON e.tail = n.node_id GROUP BY n.node_id")
def _(t):
    return network.csr(t.edges, t.places)


@query("J19_complete_connections", "SELECT a.head AS node, a.edge_id AS from_edge, b.edge_id AS to_edge FROM {edges} a JOIN {edges} b ON a.head = b.tail")
def _(t):
    return network.complete_connections(t.edges)


@query(
    "J18_A9_connection_counts",
    """SELECT a.head AS node, count(*) AS possible, CAST(sum((a.tail = b.head)::INT) AS BIGINT) AS possible_u, count(*) FILTER ((a.edge_id + b.edge_id) % 3 > 0) AS actual,
      CAST(coalesce(sum((a.tail = b.head)::INT) FILTER ((a.edge_id + b.edge_id) % 3 > 0), 0) AS BIGINT) AS actual_u FROM {edges} a JOIN {edges} b ON a.head = b.tail GROUP BY a.head""",
)
def _(t):
    c = network.complete_connections(t.edges).where((F.col("from_edge") + F.col("to_edge")) % 3 > 0).select("from_edge", "to_edge")
    return network.connection_counts(t.edges, c)


# --- joins and windows on measurements -----------------------------------------------------


@query(
    "J3_filled_measurements",
    """WITH i AS (SELECT DISTINCT begin_s FROM {measured}) SELECT e.edge_id, i.begin_s, CAST(coalesce(m.traveltime, CAST(e.weight AS DOUBLE)) AS DOUBLE) AS traveltime
    FROM {edges} e CROSS JOIN i LEFT JOIN {measured} m ON m.edge_id = e.edge_id AND m.begin_s = i.begin_s""",
)
def _(t):
    e = t.edges.select("edge_id", F.col("weight").cast("double").alias("weight"))
    return measurements.filled(e, t.measured.select("begin_s").distinct(), t.measured.select("edge_id", "begin_s", "traveltime"), "traveltime", "weight").select("edge_id", "begin_s", "traveltime")


@query("J4_calibration_pairs", "SELECT m.edge_id, m.begin_s, m.traveltime, e.weight FROM {measured} m JOIN {edges} e ON e.edge_id = m.edge_id WHERE m.sampled IS NOT NULL")
def _(t):
    return t.measured.where("sampled IS NOT NULL").join(t.edges, "edge_id").select("edge_id", "begin_s", "traveltime", "weight")


@query("J5_vehicle_query_ids", "SELECT e.event_id, coalesce(c.c_custkey, -1) AS query_id FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id AND c.c_acctbal > 0")
def _(t):
    c = t.customer.where("c_acctbal > 0").select("c_custkey")
    return t.events.join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_custkey", F.lit(-1)).alias("query_id"))


@query(
    "J6_F32_path_ids",
    """WITH p AS (SELECT l_orderkey AS q, string_agg('s' || (l_suppkey % 25), ' ' ORDER BY pos) AS path FROM {lines} GROUP BY l_orderkey),
    x AS (SELECT q, unnest(string_split(path, ' ')) AS name, unnest(range(len(string_split(path, ' ')))) AS pos FROM p)
    SELECT q AS query_id, string_agg(CAST(n.rank AS VARCHAR), ' ' ORDER BY x.pos) AS path FROM x JOIN (""" + _ORDER + """) n ON 's' || n.node_id = x.name GROUP BY q""",
)
def _(t):
    named = F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("l_suppkey") % 25).alias("s")))), lambda x: F.concat(F.lit("s"), x["s"].cast("string")))
    paths = t.lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_join(named, " ").alias("path"))
    each = paths.select("query_id", F.posexplode(F.split("path", " ")).alias("pos", "name"))
    ids = t.sql(_ORDER).select(F.concat(F.lit("s"), F.col("node_id").cast("string")).alias("name"), "rank")
    return analysis.ordered_lookup(each, ids, "query_id", "pos", "name", "rank")


@query("J7_first_parallel", "SELECT d.event_id, min(r.road_id) AS road_id FROM (SELECT event_id, CAST(event_id % 25 AS INT) AS a, CAST(user_id % 25 AS INT) AS b FROM {events}) d JOIN {roads} r ON r.tail = d.a AND r.head = d.b GROUP BY d.event_id")
def _(t):
    # The first of parallel roads is found once per pair, not once per event.
    first = t.roads.groupBy("tail", "head").agg(F.min("road_id").alias("road_id"))
    e = t.events.select("event_id", (F.col("event_id") % 25).alias("tail"), (F.col("user_id") % 25).alias("head"))
    return e.join(first, ["tail", "head"]).select("event_id", "road_id")


@query("J11_semi_join", "SELECT road_id, tail, head FROM {roads} WHERE tail IN (SELECT node_id FROM {places} WHERE region = 1) AND head IN (SELECT node_id FROM {places} WHERE region = 1)")
def _(t):
    inside = t.places.where("region = 1").select("node_id")
    r = t.roads
    return r.join(inside, r["tail"] == inside["node_id"], "left_semi").join(inside, r["head"] == inside["node_id"], "left_semi").select("road_id", "tail", "head")


@query(
    "J12_point_in_interval",
    """SELECT d.event_id, m.begin_s, m.traveltime FROM (SELECT event_id, edge_id, t / 1000.0 AS t FROM {departures}) d JOIN {measured} m ON m.edge_id = d.edge_id AND d.t >= m.begin_s AND d.t < m.begin_s + 900""",
)
def _(t):
    d = t.departures.select("event_id", "edge_id", (F.col("t") / 1000).alias("t"))
    m = t.measured.select(F.col("edge_id").alias("m_edge"), "begin_s", "traveltime")
    p = d.withColumn("begin_s", F.floor(F.col("t") / INTERVAL) * INTERVAL)
    return p.join(m, (p["edge_id"] == m["m_edge"]) & (p["begin_s"] == m["begin_s"])).select("event_id", m["begin_s"], "traveltime")


_SPANS = "SELECT event_id, edge_id, t / 1000 AS enter, t / 1000 + 60 + (event_id * 31) % 4000 AS leave FROM (SELECT event_id, edge_id, t - t % 1000 AS t FROM {departures}) d"


@query(
    "J13_D3_overlap_density",
    """WITH s AS (SELECT event_id, edge_id, (t - t % 1000) // 1000 AS enter, (t - t % 1000) // 1000 + 60 + (event_id * 31) % 4000 AS leave FROM {departures}),
    o AS (SELECT s.edge_id, k AS begin_s, CASE WHEN s.event_id % 5 = 0 THEN -1 ELSE 1 END * (least(leave, k + 900) - greatest(enter, k)) AS sec
      FROM s, range(0, 110 * 900, 900) AS r(k) WHERE enter < k + 900 AND leave > k)
    SELECT edge_id, begin_s, CAST(sum(sec) AS DOUBLE) AS vehicle_seconds FROM o GROUP BY ALL""",
)
def _(t):
    enter = F.floor(F.col("t") / 1000)
    s = t.departures.select("edge_id", enter.cast("double").alias("enter"), (enter + 60 + (F.col("event_id") * 31) % 4000).cast("double").alias("exit"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(1).alias("sign"))
    d = assignment.frozen_density(s, INTERVAL)
    return d.select("edge_id", F.col("begin_s").cast("bigint").alias("begin_s"), F.col("vehicle_seconds").cast("double").alias("vehicle_seconds"))


@query("J14_as_of", "SELECT d.event_id, d.t, p.at_ms, p.val FROM {departures} d ASOF JOIN {points} p ON d.edge_id = p.edge_id AND d.t >= p.at_ms")
def _(t):
    return measurements.as_of(t.departures.select("edge_id", "t", "event_id"), t.points.withColumnRenamed("at_ms", "at"), "edge_id", 3_600_000).select("event_id", "t", F.col("at").alias("at_ms"), "val")


@query("J15_positional_zip", "WITH a AS (SELECT weight, row_number() OVER (ORDER BY tail, head) AS k FROM {edges}), b AS (SELECT weight, row_number() OVER (ORDER BY head, tail) AS k FROM {edges}) SELECT CAST(a.k AS BIGINT) AS k, a.weight AS a, b.weight AS b FROM a JOIN b USING (k) WHERE a.weight <> b.weight")
def _(t):
    a = network.dense_ids(t.edges.select("tail", "head", F.col("weight").alias("a")), ["tail", "head"], "k")
    b = network.dense_ids(t.edges.select("tail", "head", F.col("weight").alias("b")), ["head", "tail"], "k")
    return a.select("k", "a").join(b.select("k", "b"), "k").where("a <> b").select((F.col("k") + 1).cast("bigint").alias("k"), "a", "b")


@query(
    "J16_A19_marginal_cost",
    """SELECT n.edge_id, n.begin_s, CAST(round(CASE WHEN n.vehicles <> b.vehicles THEN abs(n.traveltime - b.overlap_tt) / abs(n.vehicles - b.vehicles) * power(n.vehicles, 0.5) + n.traveltime ELSE n.traveltime END, 4) AS DOUBLE) AS cost
    FROM {measured} n JOIN {measured} b ON b.edge_id = (n.edge_id + 1) % 50 AND b.begin_s = n.begin_s""",
)
def _(t):
    before = t.measured.withColumn("edge_id", F.pmod(F.col("edge_id") - 1, F.lit(50)))
    return measurements.marginal_cost(t.measured, before, 0.5).select("edge_id", "begin_s", F.round("cost", 4).alias("cost"))


@query("N1_fifo", "SELECT edge_id, at_ms, CAST(min(at_ms + val) OVER (PARTITION BY edge_id ORDER BY at_ms DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - at_ms AS BIGINT) AS val FROM {hourly}")
def _(t):
    return measurements.fifo(t.hourly, at="at_ms")


@query("N4_run_starts", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM {events}) x WHERE b IS NULL OR b <> event_type")
def _(t):
    return measurements.run_starts(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query(
    "N5_N6_smoothed_profile",
    """WITH p AS (SELECT edge_id, list(val // 100000 ORDER BY at_ms) AS v FROM {hourly} GROUP BY edge_id),
    o AS (SELECT edge_id, list_transform(range(1, len(v) + 1), lambda i: greatest(CASE WHEN i > 21 OR i <= 4 THEN list_max(v) ELSE v[i] END, 5)) AS v FROM p),
    m AS (SELECT edge_id, list_transform(range(len(v)), lambda i: list_sum(list_transform(range(-3, 4), lambda d: v[((i + d) % len(v) + len(v)) % len(v) + 1])) // 7) AS v FROM o)
    SELECT edge_id, array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ',') AS speeds FROM m""",
)
def _(t):
    v = F.transform(F.sort_array(F.collect_list(F.struct("at_ms", "val"))), lambda x: F.call_function("div", x["val"], F.lit(100000).cast("bigint")))
    p = t.hourly.groupBy("edge_id").agg(v.alias("v")).withColumn("v", measurements.off_peak(F.col("v"), 21, 4)).withColumn("v", measurements.moving_average7(F.col("v")))
    return p.select("edge_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("speeds"))


@query(
    "N7_A11_bucket_speeds",
    """WITH s AS (SELECT event_id, edge_id, t, value AS speed, t // 900000 AS b FROM {departures}),
    w AS (SELECT *, coalesce(lead(t) OVER o, (b + 1) * 900000) - coalesce(lag(t) OVER o, b * 900000) AS w FROM s WINDOW o AS (PARTITION BY edge_id, b ORDER BY t, event_id))
    SELECT edge_id, CAST(b AS BIGINT) AS bucket, count(*) AS n, CAST(round(sum(w * speed) / sum(w), 4) AS DOUBLE) AS speed FROM w GROUP BY edge_id, b HAVING count(*) >= 3 AND sum(w) > 0""",
)
def _(t):
    s = t.departures.select("edge_id", "t", F.col("event_id").alias("sample_id"), F.col("value").alias("speed"))
    return measurements.weighted_speeds(s, 900_000).select("edge_id", F.col("bucket").cast("bigint").alias("bucket"), "n", F.round("speed", 4).alias("speed"))


@query(
    "A10_import_counts",
    """SELECT count(*) AS total, count(*) FILTER (k AND s <= 999 AND r) AS applied, count(*) FILTER (NOT k) AS no_edge, count(*) FILTER (k AND s > 999) AS too_fast, count(*) FILTER (k AND s <= 999 AND NOT r) AS out_of_range
    FROM (SELECT user_id % 7 > 0 AS k, CASE WHEN event_id % 11 = 0 THEN 1000.0 ELSE value END AS s, event_id % 5 > 0 AS r FROM {events}) x""",
)
def _(t):
    speed = F.when(F.col("event_id") % 11 == 0, 1000.0).otherwise(F.col("value"))
    return measurements.import_counts(t.events.select((F.col("user_id") % 7 > 0).alias("known"), speed.alias("speed"), (F.col("event_id") % 5 > 0).alias("in_range")))


@query("N8_cumulative_distance", "SELECT l_orderkey, pos, CAST(round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY pos), 2) AS DOUBLE) AS upto FROM {lines}")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return t.lines.select("l_orderkey", "pos", F.round(F.sum("l_extendedprice").over(w), 2).alias("upto"))


_RANGES = "SELECT l_orderkey AS q, CAST(l_partkey % 20 AS BIGINT) AS b, CAST(l_partkey % 20 + l_suppkey % 9 + 1 AS BIGINT) AS e FROM {lineitem}"


@query("N15_uncovered_ranges", f"WITH r AS (SELECT DISTINCT * FROM ({_RANGES}) x) SELECT q, b AS begin, e AS \"end\" FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.q = x.q AND y.b >= x.b AND y.e <= x.e AND (y.b, y.e) <> (x.b, x.e))")
def _(t):
    r = t.sql(_RANGES).select("q", F.col("b").alias("begin"), F.col("e").alias("end"))
    return measurements.uncovered_ranges(r, "q")


@query(
    "U5_gaps",
    f"WITH r AS ({_RANGES}), m AS (SELECT q, b, max(e) OVER (PARTITION BY q ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM r) SELECT q, f AS \"from\", b AS \"to\" FROM m WHERE b > f",
)
def _(t):
    return measurements.gaps(t.sql(_RANGES).select("q", F.col("b").alias("begin"), F.col("e").alias("end")), "q")


# --- travel-time functions -----------------------------------------------------------------

_AROUND = """q AS (SELECT event_id, edge_id, t FROM {departures}), n AS (SELECT edge_id, count(*) AS n, arg_min(val, at_ms) AS first_val, min(val) AS lo, max(val) AS hi FROM {points} GROUP BY edge_id),
    b AS (SELECT q.event_id, q.edge_id, q.t, p.at_ms, p.val FROM q ASOF JOIN {points} p ON q.edge_id = p.edge_id AND q.t >= p.at_ms),
    x AS (SELECT b.*, min(p.at_ms) AS at2, arg_min(p.val, p.at_ms) AS val2 FROM b JOIN {points} p ON p.edge_id = b.edge_id AND p.at_ms > b.at_ms GROUP BY ALL)"""
_EVAL = "CASE WHEN n.n <= 2 THEN n.first_val WHEN x.t = x.at_ms THEN x.val ELSE x.at_ms + x.val + ((x.t - x.at_ms) * (x.at2 + x.val2 - x.at_ms - x.val)) // (x.at2 - x.at_ms) - x.t END"


@query("F1_eval", f"WITH {_AROUND} SELECT x.event_id, CAST({_EVAL} AS BIGINT) AS tt FROM x JOIN n USING (edge_id)")
def _(t):
    return t.departures.join(_small_functions(t), "edge_id").select("event_id", ttf.eval_ms(F.col("f"), F.col("t")).alias("tt"))


@query(
    "F2_eval_seconds",
    f"WITH {_AROUND} SELECT x.event_id, CAST(round(CASE WHEN x.t = x.at_ms THEN x.val / 1000.0 ELSE (x.val + (x.t - x.at_ms) * (x.val2 - x.val) / (x.at2 - x.at_ms)) / 1000.0 END, 3) AS DOUBLE) AS tt FROM x",
)
def _(t):
    p = t.points.select("edge_id", (F.col("at_ms") / 1000).alias("at"), (F.col("val") / 1000).alias("val"))
    f = p.groupBy("edge_id").agg(ttf.collect().alias("f"))
    return t.departures.join(if_small(f, FUNCTIONS), "edge_id").select("event_id", F.round(ttf.eval_s(F.col("f"), F.col("t") / 1000), 3).alias("tt"))


@query("A3_bounds", "SELECT edge_id, min(val) AS lo, max(val) AS hi FROM {points} GROUP BY edge_id")
def _(t):
    return _functions(t).select("edge_id", ttf.lower_bound(F.col("f")).alias("lo"), ttf.upper_bound(F.col("f")).alias("hi"))


@query(
    "A4_average_in_range",
    """WITH r(a, b) AS (VALUES (25200000, 36000000), (79200000, 18000000), (0, 0)),
    s AS (SELECT edge_id, at_ms, val, lead(at_ms) OVER w AS at2, lead(val) OVER w AS val2 FROM {points} WINDOW w AS (PARTITION BY edge_id ORDER BY at_ms)),
    m AS (SELECT edge_id, a, b, CASE WHEN a >= b THEN b + 86400000 ELSE b END AS stop, s.* EXCLUDE (edge_id) FROM s, r WHERE at2 IS NOT NULL),
    o AS (SELECT *, greatest(0, least(at2, least(stop, 86400000)) - greatest(at_ms, a)) + greatest(0, least(at2, stop - 86400000) - greatest(at_ms, 0)) AS d FROM m)
    SELECT edge_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(sum((val + val2) * d) // 2 // (any_value(stop) - a) AS BIGINT) AS mean FROM o GROUP BY edge_id, a, b""",
)
def _(t):
    r = t.spark.createDataFrame([(25200000, 36000000), (79200000, 18000000), (0, 0)], "a bigint, b bigint")
    return _functions(t).crossJoin(F.broadcast(r)).select("edge_id", "a", "b", ttf.average(F.col("f"), F.col("a"), F.col("b")).alias("mean"))


_BOTH_ENDS = _AROUND.replace("SELECT event_id, edge_id, t FROM {departures}", "SELECT event_id * 2 + k AS event_id, edge_id, t + k * 7200000 AS t FROM {departures}, range(2) AS r(k) WHERE t + 7200000 < 86400000")


@query(
    "F4_bounds_in_range",
    f"""WITH {_BOTH_ENDS}, e AS (SELECT x.event_id // 2 AS event_id, x.edge_id, x.t, {_EVAL} AS v FROM x JOIN n USING (edge_id)),
    g AS (SELECT event_id, edge_id, min(t) AS t1, max(t) AS t2, min(v) AS lo, max(v) AS hi FROM e GROUP BY ALL)
    SELECT g.event_id, CAST(least(g.lo, min(p.val)) AS BIGINT) AS lo, CAST(greatest(g.hi, max(p.val)) AS BIGINT) AS hi
    FROM g LEFT JOIN {{points}} p ON p.edge_id = g.edge_id AND p.at_ms BETWEEN g.t1 AND g.t2 GROUP BY g.event_id, g.lo, g.hi""",
)
def _(t):
    d = t.departures.where("t + 7200000 < 86400000").join(_small_functions(t), "edge_id")
    f, a, b = F.col("f"), F.col("t"), F.col("t") + 7_200_000
    return d.select("event_id", ttf.lower_bound_in(f, a, b).alias("lo"), ttf.upper_bound_in(f, a, b).alias("hi"))


@query("N12_A21_slopes", "WITH s AS (SELECT edge_id, (lead(val) OVER w - val) / (lead(at_ms) OVER w - at_ms)::DOUBLE AS s FROM {points} WINDOW w AS (PARTITION BY edge_id ORDER BY at_ms)) SELECT edge_id, CAST(round(min(s), 9) AS DOUBLE) AS lo, CAST(round(max(s), 9) AS DOUBLE) AS hi, count(*) FILTER (s < -1) AS violations FROM s WHERE s IS NOT NULL GROUP BY edge_id")
def _(t):
    s = _functions(t).withColumn("s", ttf.slopes(F.col("f")))
    return s.select("edge_id", F.round(F.array_min("s"), 9).alias("lo"), F.round(F.array_max("s"), 9).alias("hi"), F.size(F.filter("s", lambda x: x < -1)).cast("bigint").alias("violations"))


@query("P30_P31_trimmed", "SELECT edge_id, at_ms, greatest(val, 1500000) AS val FROM {points} WHERE at_ms <> 86400000")
def _(t):
    return _functions(t).select("edge_id", F.inline(ttf.at_least(ttf.without_period(F.col("f")), 1_500_000))).withColumnRenamed("at", "at_ms")


@query("A6_counts", "SELECT count(*) AS functions, CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (n = 1) AS constant FROM (SELECT edge_id, count(*) AS n FROM {points} GROUP BY edge_id) x")
def _(t):
    f = _functions(t)
    return f.agg(F.count(F.lit(1)).alias("functions"), F.sum(F.size("f")).alias("points"), F.count_if(F.size("f") == 1).alias("constant"))


@query("N2_F11_valid", "SELECT edge_id, CAST(count(*) AS BIGINT) AS points, TRUE AS valid FROM {points} GROUP BY edge_id")
def _(t):
    return _functions(t).select("edge_id", F.size("f").cast("bigint").alias("points"), ttf.is_valid(F.col("f")).alias("valid"))


@query(
    "F13_live_optimistic",
    f"""WITH {_AROUND}, e AS (SELECT x.event_id, x.edge_id, x.t, {_EVAL} AS v FROM x JOIN n USING (edge_id)),
    s AS (SELECT p.edge_id, p.val AS soon_v FROM {{points}} p WHERE p.at_ms = 0)
    SELECT e.event_id, CAST(CASE WHEN e.edge_id % 3 = 0 THEN e.v WHEN e.t < 0 THEN 0 ELSE CASE WHEN s.soon_v < 2000000 THEN greatest(greatest(2000000 - e.t, 0), e.v) ELSE least(2000000 + e.t, e.v) END END AS BIGINT) AS tt
    FROM e JOIN s USING (edge_id)""",
)
def _(t):
    d = t.departures.join(_small_functions(t), "edge_id")
    live = F.when(F.col("edge_id") % 3 != 0, F.lit(2_000_000).cast("bigint"))
    return d.select("event_id", ttf.live_optimistic(F.col("f"), live, F.lit(0).cast("bigint"), F.col("t")).alias("tt"))


@query(
    "F14_live_pessimistic",
    f"""WITH {_AROUND}, e AS (SELECT x.event_id, x.edge_id, x.t, {_EVAL} AS v FROM x JOIN n USING (edge_id)), s AS (SELECT p.edge_id, p.val AS v0 FROM {{points}} p WHERE p.at_ms = 86400000)
    SELECT e.event_id, CAST(CASE WHEN e.edge_id % 3 = 0 THEN e.v ELSE greatest(e.v, least(5000000, s.v0 + 86400000 - e.t)) END AS BIGINT) AS tt FROM e JOIN s USING (edge_id)""",
)
def _(t):
    d = t.departures.join(_small_functions(t), "edge_id")
    live = F.when(F.col("edge_id") % 3 != 0, F.lit(5_000_000).cast("bigint"))
    return d.select("event_id", ttf.live_pessimistic(F.col("f"), live, F.lit(86_400_000).cast("bigint"), F.col("t")).alias("tt"))


#: Hops of each order's path, and the time after each.
_PATH = """WITH RECURSIVE seg AS (SELECT edge_id, at_ms AS a, val AS v, lead(at_ms) OVER w AS b, lead(val) OVER w AS u FROM {points} WINDOW w AS (PARTITION BY edge_id ORDER BY at_ms)),
    h AS (SELECT l_orderkey AS q, CAST(l_suppkey % 50 AS INT) AS edge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM {lines} WHERE l_suppkey % 50 IN (SELECT edge_id FROM {points})),
    r(q, k, t) AS (SELECT DISTINCT q, CAST(0 AS BIGINT), CAST(q * 7919 % 86400000 AS BIGINT) FROM h
      UNION ALL SELECT r.q, h.k, CAST(r.t + s.a + s.v + (r.t % 86400000 - s.a) * (s.b + s.u - s.a - s.v) // (s.b - s.a) - r.t % 86400000 AS BIGINT)
        FROM r JOIN h ON h.q = r.q AND h.k = r.k + 1 JOIN seg s ON s.edge_id = h.edge_id AND r.t % 86400000 >= s.a AND r.t % 86400000 < s.b)"""


@query("F10_N9_path_times", _PATH + " SELECT q, CAST(max(t) - min(t) AS BIGINT) AS tt, CAST(max(t) AS BIGINT) AS arrival FROM r GROUP BY q")
def _(t):
    hops = t.lines.select(F.col("l_orderkey").alias("q"), "pos", (F.col("l_suppkey") % 50).cast("int").alias("edge_id"))
    functions = _functions(t)
    if functions.count() <= FUNCTIONS:  # only edges' numbers are gathered by path; the functions are sent to the tasks
        known = hops.join(F.broadcast(functions.select("edge_id")), "edge_id", "left_semi")
        paths = known.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "edge_id"))), lambda x: x["edge_id"]).alias("path"))
        return search.path_times(paths.withColumn("departure", F.pmod(F.col("q") * 7919, F.lit(86_400_000))), functions).select("q", "tt", "arrival")
    hops = hops.join(functions, "edge_id")
    paths = hops.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("fs"))
    depart = F.pmod(F.col("q") * 7919, F.lit(86_400_000))
    return paths.select("q", ttf.along(F.col("fs"), depart).alias("tt"), F.element_at(ttf.timed_path(F.col("fs"), depart), -1).alias("arrival"))


# --- aggregations ---------------------------------------------------------------------------


@query(
    "A1_A2_relative_gap",
    "SELECT CAST(round(sum(CASE WHEN abs(d) < 1 OR d < 0 THEN 0 ELSE d END) / sum(b), 9) AS DOUBLE) AS gap, CAST(round(sum(s), 2) AS DOUBLE) AS experienced, count(*) AS trips FROM (SELECT o_totalprice AS s, o_totalprice - (o_orderkey % 100 - 20) AS b, o_orderkey % 100 - 20 AS d FROM {orders}) x",
)
def _(t):
    o = t.orders.select(F.col("o_totalprice").alias("simulated"), (F.col("o_totalprice") - (F.col("o_orderkey") % 100 - 20)).alias("best"))
    return assignment.relative_gap(o).select(F.round("gap", 9).alias("gap"), F.round("experienced", 2).alias("experienced"), "trips")


@query(
    "A5_delay_stats",
    """WITH e AS (SELECT edge_id, (max(val) - min(val)) / min(val)::DOUBLE AS d, count(*) AS n FROM {points} GROUP BY edge_id), v AS (SELECT list(d ORDER BY floor(d * 1000), edge_id) AS l FROM e WHERE n > 1)
    SELECT CAST(round(avg(d), 6) AS DOUBLE) AS mean, CAST(round(avg(d) FILTER (n > 1), 6) AS DOUBLE) AS mean_varying, CAST(round(sum(d), 6) AS DOUBLE) AS total, CAST(round(any_value(l[len(l) // 2 + 1]), 6) AS DOUBLE) AS median FROM e, v""",
)
def _(t):
    return analysis.delay_stats(_functions(t))


@query("A7_speeds", "SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, CAST(round(avg(v), 6) AS DOUBLE) AS mean FROM (SELECT coalesce(speed, 13.9) AS v FROM {roads}) x")
def _(t):
    v = roads.speed_or_default(F.col("speed"))
    return t.roads.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 6).alias("mean"))


_RUNS = "SELECT o_orderstatus AS algorithm, CAST(o_custkey % 10 AS INT) AS iteration, o_orderpriority AS phase, o_totalprice AS value, o_orderkey AS run FROM {orders}"


@query(
    "A12_iteration_stats",
    f"SELECT algorithm, iteration, count(*) AS n, CAST(round(avg(value), 4) AS DOUBLE) AS mean, CAST(round(quantile_cont(value, 0.5), 4) AS DOUBLE) AS median, CAST(round(min(value), 4) AS DOUBLE) AS lo, CAST(round(stddev_pop(value), 3) AS DOUBLE) AS std FROM ({_RUNS}) x GROUP BY ALL",
)
def _(t):
    return analysis.iteration_stats(t.sql(_RUNS), ["algorithm", "iteration"])


@query(
    "A13_pairwise_stats",
    f"""WITH r AS (SELECT algorithm, iteration, avg(value) AS v FROM ({_RUNS}) x GROUP BY ALL), p AS (SELECT a.algorithm AS a, b.algorithm AS b, a.v - b.v AS d FROM r a JOIN r b ON a.iteration = b.iteration AND a.algorithm < b.algorithm)
    SELECT a, b, count(*) AS n, CAST(round(avg(d), 3) AS DOUBLE) AS mean_diff, CAST(round(quantile_cont(d, 0.5), 3) AS DOUBLE) AS median_diff, CAST(round(avg(abs(d)), 3) AS DOUBLE) AS mad, CAST(round(sqrt(avg(d * d)), 3) AS DOUBLE) AS rmse FROM p GROUP BY a, b""",
)
def _(t):
    r = t.sql(_RUNS).groupBy("algorithm", "iteration").agg(F.avg("value").alias("v"))
    return analysis.pairwise(r, "algorithm", "iteration", "v")


@query(
    "A14_describe",
    f"""SELECT count(*) AS n, CAST(round(avg(value), 4) AS DOUBLE) AS mean, CAST(round(stddev_samp(value), 3) AS DOUBLE) AS std, CAST(min(value) AS DOUBLE) AS lo, CAST(round(quantile_cont(value, 0.25), 4) AS DOUBLE) AS q25,
      CAST(round(quantile_cont(value, 0.5), 4) AS DOUBLE) AS q50, CAST(round(quantile_cont(value, 0.75), 4) AS DOUBLE) AS q75, CAST(max(value) AS DOUBLE) AS hi FROM ({_RUNS}) x""",
)
def _(t):
    return analysis.describe(t.sql(_RUNS), "value")


@query(
    "A15_histogram",
    """WITH d AS (SELECT l_extendedprice AS v FROM {lineitem}), m AS (SELECT floor(min(v)) AS b0, max(v) AS b1 FROM d), b AS (SELECT unnest(range(0, CAST(floor((b1 - b0) / 500.0) AS BIGINT) + 1)) AS bin, b0 FROM m)
    SELECT b.bin, CAST(b.b0 + b.bin * 500.0 AS DOUBLE) AS start, (SELECT count(*) FROM d, m WHERE floor((v - m.b0) / 500.0) = b.bin) AS n FROM b""",
)
def _(t):
    h = measurements.histogram(t.lineitem.select(F.col("l_extendedprice").alias("v")), "v", 500.0)
    return h.select("bin", F.col("start").cast("double").alias("start"), "n")


@query(
    "A16_r_squared",
    "SELECT edge, CAST(round(CASE WHEN count(*) = 0 OR var_pop(y) = 0 THEN 0 ELSE 1 - sum(power(y - f, 2)) / (count(*) * var_pop(y)) END, 6) AS DOUBLE) AS r2 FROM (SELECT l_suppkey AS edge, l_extendedprice AS y, l_quantity * 1000 AS f FROM {lineitem}) x GROUP BY edge",
)
def _(t):
    return analysis.r_squared(t.lineitem.select(F.col("l_suppkey").alias("edge"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("f")), "edge", "y", "f")


@query("A17_phase_means", f"SELECT algorithm, phase, CAST(round(avg(value), 4) AS DOUBLE) AS mean, count(*) AS n FROM ({_RUNS}) x WHERE iteration > 0 GROUP BY ALL")
def _(t):
    r = t.sql(_RUNS).where("iteration > 0")
    return r.groupBy("algorithm", "phase").agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    "A18_convergence",
    f"""WITH s AS (SELECT algorithm, iteration, avg(value) AS v FROM ({_RUNS}) x GROUP BY ALL)
    SELECT algorithm, iteration, CAST(round(v, 4) AS DOUBLE) AS mean, CAST(round(stddev_pop(v) OVER w / avg(v) OVER w, 6) AS DOUBLE) AS rel_std FROM s WINDOW w AS (PARTITION BY algorithm ORDER BY iteration ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    s = t.sql(_RUNS).groupBy("algorithm", "iteration").agg(F.avg("value").alias("v"))
    return analysis.convergence(s, "algorithm", "iteration", "v", 5)


# --- sort, limit, sets ----------------------------------------------------------------------


@query("O1_F31_route_order", "SELECT o_orderkey, CAST(o_totalprice * 1000 AS BIGINT) AS depart_ms, 'run_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.rou.xml' AS file FROM {orders} ORDER BY depart_ms, o_orderkey")
def _(t):
    o = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 1000).cast("bigint").alias("depart_ms"), roads.route_file(F.lit("run"), F.col("o_custkey") % 1000).alias("file"))
    return o.orderBy("depart_ms", "o_orderkey")


@query("O2_top_differences", "SELECT o_orderkey, CAST(round(o_totalprice - 1000 * (o_custkey % 50), 2) AS DOUBLE) AS d FROM {orders} WHERE o_totalprice - 1000 * (o_custkey % 50) > 1 ORDER BY d DESC, o_orderkey LIMIT 20")
def _(t):
    d = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") - 1000 * (F.col("o_custkey") % 50), 2).alias("d"))
    return d.where("d > 1").orderBy(F.desc("d"), "o_orderkey").limit(20)


@query(
    "O4_prune_alternatives",
    """WITH a AS (SELECT query_id, alt_ix, cost / sum(cost) OVER (PARTITION BY query_id) AS prob FROM {alternatives}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prob, alt_ix) AS k, count(*) OVER (PARTITION BY query_id) - 3 AS d FROM a),
    s AS (SELECT *, sum(prob) OVER (PARTITION BY query_id) AS p FROM r WHERE k > d)
    SELECT query_id, alt_ix, CAST(round(CASE WHEN d > 0 THEN prob / p ELSE prob END, 9) AS DOUBLE) AS prob FROM s""",
)
def _(t):
    a = t.alternatives.select("query_id", "alt_ix", (F.col("cost") / F.sum("cost").over(Window.partitionBy("query_id"))).alias("prob"))
    return assignment.prune(a, 3).select("query_id", "alt_ix", F.round("prob", 9).alias("prob"))


@query("O8_multiplied_trips", "WITH k AS (SELECT o_orderkey, unnest([1, 2, 3]) AS c FROM {orders} WHERE o_orderkey % 10 <> 0) SELECT CAST(row_number() OVER (ORDER BY o_orderkey, c) AS BIGINT) AS id, o_orderkey FROM k")
def _(t):
    kept = t.orders.select("o_orderkey").where("o_orderkey % 10 <> 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return network.dense_ids(kept, ["o_orderkey", "c"], "id").select((F.col("id") + 1).cast("bigint").alias("id"), "o_orderkey")


@query("U1_union", "SELECT edge_id, tail, head, TRUE AS forward FROM {edges} UNION ALL SELECT edge_id, head, tail, FALSE FROM {edges}")
def _(t):
    return t.edges.select("edge_id", "tail", "head", F.lit(True).alias("forward")).unionByName(network.reverse(t.edges).select("edge_id", "tail", "head", F.lit(False).alias("forward")))


@query("U3_common_iterations", f"SELECT iteration FROM ({_RUNS}) x WHERE algorithm = 'F' INTERSECT SELECT iteration FROM ({_RUNS}) x WHERE algorithm = 'O'")
def _(t):
    r = t.sql(_RUNS)
    return r.where("algorithm = 'F'").select("iteration").intersect(r.where("algorithm = 'O'").select("iteration"))


# --- scalar functions -----------------------------------------------------------------------


@query("F17_F18_F21_density_speed", """WITH m AS (SELECT edge_id, begin_s, least(1000.0 * sampled / (900 * (100.0 + edge_id)) / 2, 60.0) AS d, 100.0 + edge_id AS len FROM {measured}),
    v AS (SELECT *, 50.0 * (1 - power(d / 60.0, 2)) / (1 + power(d / 60.0, 0.5)) AS v FROM m)
    SELECT edge_id, begin_s, CAST(round(d, 6) AS DOUBLE) AS density, CAST(round(v, 6) AS DOUBLE) AS speed, CAST(round(CASE WHEN abs(v) < 1e-6 OR v < 0 OR len / (v / 3.6) > 100000 THEN 100000 ELSE len / (v / 3.6) END, 4) AS DOUBLE) AS estimated FROM v""")
def _(t):
    m = t.measured.select("edge_id", "begin_s", "sampled", "overlap_tt", (100.0 + F.col("edge_id")).alias("length"), F.lit(2).alias("lanes"), F.lit(50.0).alias("free_flow"))
    s = assignment.speeds_by_density(m, INTERVAL)
    return s.select("edge_id", "begin_s", F.round("density", 6).alias("density"), F.round("speed", 6).alias("speed"), F.round("estimated", 4).alias("estimated"))


@query("F28_F29_F30_parsing", """SELECT o_orderkey, CAST(o_orderkey % 30 * 3600 + o_custkey % 60 * 60 + o_orderkey % 60 AS DOUBLE) AS seconds, 'e' || (o_custkey % 225) AS edge, CAST(o_custkey AS VARCHAR) AS node, CAST((o_orderkey % 30 * 3600 + o_custkey % 60 * 60 + o_orderkey % 60) * 1000000000 AS BIGINT) AS ns FROM {orders}""")
def _(t):
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", pad(F.col("o_orderkey") % 30), pad(F.col("o_custkey") % 60), pad(F.col("o_orderkey") % 60))
    place = F.concat(F.lit("(48.1,9.2: e"), (F.col("o_custkey") % 225).cast("string"), F.lit(", 0.5)"))
    node = F.concat(F.col("o_custkey").cast("string"), F.lit('"e1'))
    return t.orders.select("o_orderkey", roads.seconds_of(clock).alias("seconds"), roads.located_edge(place).alias("edge"), roads.node_of_expanded(node).alias("node"), roads.duration_ns(clock).alias("ns"))


@query("F33_breakpoints", "SELECT n_nationkey, unnest(range(n_nationkey * 100, 3600, 600)) AS at_s FROM {nation}")
def _(t):
    n = F.col("n_nationkey")
    return t.nation.select("n_nationkey", F.explode(roads.breakpoints(n * 100, F.lit(3600), F.lit(600))).alias("at_s")).select("n_nationkey", F.col("at_s").cast("bigint").alias("at_s"))


@query(
    "F22_gawron_pairs",
    """WITH p AS (SELECT query_id, max(cost) FILTER (alt_ix = 0) AS c0, max(cost) FILTER (alt_ix = 1) AS c1 FROM {alternatives} GROUP BY query_id HAVING count(*) = 2 AND min(alt_ix) = 0 AND max(alt_ix) = 1),
    x AS (SELECT *, (c1 - c0) / (c1 + c0) AS x FROM p), g AS (SELECT *, exp(0.5 * x / (1 - x * x)) AS g FROM x), n AS (SELECT *, 0.5 * g / (0.5 * g + 0.5) AS p0 FROM g)
    SELECT query_id, CAST(round(p0, 8) AS DOUBLE) AS p0, CAST(round(1 - p0, 8) AS DOUBLE) AS p1 FROM n""",
)
def _(t):
    g = t.alternatives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alt_ix", "cost", "prob"))).alias("r")).where("size(r) = 2 AND r[0].alt_ix = 0 AND r[1].alt_ix = 1")
    p = assignment.gawron(F.transform("r", lambda x: x["cost"]), F.transform("r", lambda x: x["prob"].cast("double")))
    return g.select("query_id", p.alias("p")).select("query_id", F.round(F.col("p")[0], 8).alias("p0"), F.round(F.col("p")[1], 8).alias("p1"))


@query("F22_gawron")
def _(t):
    g = t.alternatives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alt_ix", "cost", "prob"))).alias("r"))
    p = assignment.gawron(F.transform("r", lambda x: x["cost"]), F.transform("r", lambda x: x["prob"].cast("double")))
    return g.select("query_id", F.posexplode(p).alias("alt_ix", "prob")).select("query_id", "alt_ix", F.round("prob", 9).alias("prob"))


@query(
    "F23_c_logit",
    """WITH a AS (SELECT query_id, alt_ix, cost, [partkey % 5, suppkey % 5] AS path FROM {alternatives}),
    o AS (SELECT x.query_id, x.alt_ix, x.cost, sum((CASE WHEN x.path = y.path THEN least(x.cost, y.cost) ELSE len(list_filter(x.path, lambda e: list_contains(y.path, e))) * (x.cost / 2 + y.cost / 2) / 2 END) / sqrt(x.cost * y.cost)) AS s
      FROM a x JOIN a y USING (query_id) GROUP BY ALL),
    u AS (SELECT query_id, alt_ix, cost + 0.7 * ln(s) AS u FROM o)
    SELECT x.query_id, x.alt_ix, CAST(round(1 / sum(exp(0.0001 * (x.u - y.u))), 6) AS DOUBLE) AS prob FROM u x JOIN u y USING (query_id) GROUP BY x.query_id, x.alt_ix""",
)
def _(t):
    path = F.array(F.col("partkey") % 5, F.col("suppkey") % 5)
    g = t.alternatives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("alt_ix", "cost", path.alias("path")))).alias("r"))
    p = assignment.c_logit(F.transform("r", lambda x: x["cost"]), F.transform("r", lambda x: x["path"]), beta=0.7, gamma=1.0, theta=0.0001)
    return g.select("query_id", F.explode(F.arrays_zip(F.transform("r", lambda x: x["alt_ix"]).alias("a"), p.alias("p"))).alias("z")).select("query_id", F.col("z.a").alias("alt_ix"), F.round("z.p", 6).alias("prob"))


@query("F24_choice", f"WITH c AS (SELECT query_id, alt_ix, sum(prob::DOUBLE) OVER (PARTITION BY query_id ORDER BY alt_ix ROWS UNBOUNDED PRECEDING) AS upto, sum(prob::DOUBLE) OVER (PARTITION BY query_id) AS whole, {_draw('query_id', 5)} / {_U} AS u FROM {{alternatives}}) SELECT query_id, CAST(min(alt_ix) AS INT) AS alt_ix FROM c WHERE upto > u * whole GROUP BY query_id")
def _(t):
    return assignment.choose(t.alternatives, 5)


@query("F25_F26_samples", f"WITH r AS (SELECT o_orderkey AS query_id, row_number() OVER (ORDER BY {_draw('o_orderkey', 3)}, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM {{orders}}) SELECT query_id, CASE WHEN k < floor(n * 0.5 + 0.5) THEN 0 WHEN k < floor(n * 0.5 + 0.5) + floor(n * 0.3 + 0.5) THEN 1 ELSE 2 END AS sample, {_draw('query_id', 4)} / {_U} < 0.25 AS keeps FROM r")
def _(t):
    q = t.orders.select(F.col("o_orderkey").alias("query_id"))
    return assignment.kept_routes(assignment.samples(q, [0.5, 0.3, 0.2], 3), 0.25, 4)


# --- graph queries --------------------------------------------------------------------------

_DIST = """WITH RECURSIVE """


def _rounds(n: int) -> str:
    """Shortest distances of all pairs by repeated squaring: after k rounds, paths of 2^k edges."""
    ctes = ["d0 AS (SELECT tail AS s, head AS v, weight AS d FROM {edges} UNION ALL SELECT node_id, node_id, 0 FROM {places})"]
    for k in range(n):
        ctes.append(f"d{k + 1} AS (SELECT a.s, b.v, min(a.d + b.d) AS d FROM d{k} a JOIN d{k} b ON a.v = b.s GROUP BY a.s, b.v)")
    return "WITH " + ", ".join(ctes)


_ALL = _rounds(5)


def _distances(t: Tables) -> DataFrame:
    return search.relax(t.edges, t.places.select(F.col("node_id").alias("source")))


@query("G1_G2_A22_all_distances", f"{_ALL} SELECT s AS source, v AS node, CAST(d AS BIGINT) AS dist FROM d5")
def _(t):
    return _distances(t)


_STQ = "SELECT c_custkey AS query_id, c_nationkey AS source, CAST(c_custkey * 7 % 25 AS INT) AS target FROM {customer}"


@query("G2_queries", f"{_ALL} SELECT q.query_id, q.source, q.target, CAST(d.d AS BIGINT) AS dist FROM ({_STQ}) q LEFT JOIN d5 d ON d.s = q.source AND d.v = q.target")
def _(t):
    return search.dijkstra(t.sql(_STQ), search.load_graph(t.edges)).select("query_id", "source", "target", "dist")


def _hubs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Labels from the hierarchy's ancestors; a node without edges is its own hub."""
    graph = search.load_graph(t.edges)
    metric = hierarchy.Hierarchy(graph, hierarchy.min_degree_order(graph)).customize(perfect=True)
    nodes = t.places.select(F.col("node_id").alias("node"))
    own = nodes.select(F.col("node").cast("bigint").alias("node"), (-1 - F.col("node")).cast("bigint").alias("hub"), F.lit(0).cast("bigint").alias("d"))
    out, into = (hierarchy.ancestor_labels(nodes, metric, forward).unionByName(own) for forward in (True, False))
    return out, into


@query("J8_G18_hub_labels", f"{_ALL} SELECT q.source, q.target, CAST(d.d AS BIGINT) AS dist FROM (SELECT DISTINCT source, target FROM ({_STQ}) x) q JOIN d5 d ON d.s = q.source AND d.v = q.target")
def _(t):
    out, into = _hubs(t)
    return search.label_distances(t.sql(_STQ).select("source", "target").distinct(), out, into).select("source", "target", "dist")


@query("J10_G19_many_to_many", f"{_ALL} SELECT s AS source, v AS target, CAST(d AS BIGINT) AS dist FROM d5 WHERE s IN (SELECT node_id FROM {{places}} WHERE region IN (0, 1, 2)) AND v IN (SELECT node_id FROM {{places}} WHERE region IN (2, 3, 4))")
def _(t):
    out, into = _hubs(t)
    n = t.places
    return search.many_to_many(n.where("region IN (0, 1, 2)").select(F.col("node_id").alias("source")), n.where("region IN (2, 3, 4)").select(F.col("node_id").alias("target")), out, into)


@query("O3_G8_nearest", f"{_ALL} SELECT s AS source, v AS node, CAST(d AS BIGINT) AS dist, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, v) AS k FROM d5 WHERE v IN (SELECT node_id FROM {{places}} WHERE region > 1)) x WHERE k <= 4")
def _(t):
    return search.nearest(_distances(t), t.places.where("region > 1").select(F.col("node_id").alias("target")), 4)


@query("N10_ranks", f"{_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, v) AS k FROM d5) SELECT s AS source, CAST(log2(k) AS INT) AS k, v AS node, CAST(d AS BIGINT) AS dist FROM r WHERE k IN (1, 2, 4, 8, 16)")
def _(t):
    return search.settled_ranks(_distances(t))


@query("N11_first_beyond", f"{_ALL} SELECT s AS source, arg_min(v, d * 1000 + v) AS node, CAST(min(d) AS BIGINT) AS dist FROM d5 WHERE d > 300 GROUP BY s")
def _(t):
    return search.first_beyond(_distances(t), 300)


@query("G11_landmark_bounds", f"{_ALL}, l AS (SELECT s AS l, v AS n, d FROM d5 WHERE s IN (0, 7, 13)), q AS (SELECT a.node_id AS source, b.node_id AS target FROM {{places}} a, {{places}} b) SELECT source, target, CAST(greatest(max(b), 0) AS BIGINT) AS bound FROM (SELECT q.source, q.target, t.d - s.d AS b FROM q JOIN l s ON s.n = q.source JOIN l t ON t.n = q.target AND t.l = s.l) x GROUP BY ALL")
def _(t):
    d = search.relax(t.edges, t.places.where("node_id IN (0, 7, 13)").select(F.col("node_id").alias("source")))
    n = t.places.select("node_id")
    q = n.select(F.col("node_id").alias("source")).crossJoin(F.broadcast(n.select(F.col("node_id").alias("target"))))
    return search.landmark_bounds(q, d, d.limit(0))


@query("J9_triangles", f"WITH o AS ({_ORDER}), u AS (SELECT DISTINCT least(a.rank, b.rank) AS low, greatest(a.rank, b.rank) AS high FROM {{edges}} e JOIN o a ON a.node_id = e.tail JOIN o b ON b.node_id = e.head) SELECT x.low AS m, x.high AS a, y.high AS b FROM u x JOIN u y ON x.low = y.low AND x.high < y.high JOIN u z ON z.low = x.high AND z.high = y.high")
def _(t):
    up = network.split_by_rank(network.permute(t.edges, t.sql(_ORDER))).groupBy("low", "high").agg(F.min("weight").alias("weight"))
    return search.triangles(up).select("m", "a", "b")


@query("G4_pareto", "SELECT DISTINCT l_suppkey, l_quantity, l_extendedprice FROM {lineitem} x WHERE NOT EXISTS (SELECT 1 FROM {lineitem} y WHERE y.l_suppkey = x.l_suppkey AND y.l_quantity <= x.l_quantity AND y.l_extendedprice <= x.l_extendedprice AND (y.l_quantity, y.l_extendedprice) <> (x.l_quantity, x.l_extendedprice))")
def _(t):
    return search.pareto(t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"], "l_quantity", "l_extendedprice")


# --- kernels --------------------------------------------------------------------------------


def _seconds(t: Tables) -> DataFrame:
    p = t.points.select("edge_id", (F.col("at_ms") / 1000).alias("at"), (F.col("val") / 1000).alias("val"))
    return p.groupBy("edge_id").agg(ttf.collect().alias("f"))


def _pairs(t: Tables) -> DataFrame:
    f = _seconds(t)
    g = f.select(F.pmod(F.col("edge_id") - 1, F.lit(50)).alias("edge_id"), F.col("f").alias("g"))
    return f.join(g, "edge_id")


_SECOND_EVAL = """q AS (SELECT event_id, edge_id, t / 1000.0 AS t FROM {departures}),
    fb AS (SELECT q.event_id, q.edge_id, q.t, p.at_ms / 1000.0 AS x, p.val / 1000.0 AS v, p.at_ms FROM q ASOF JOIN {points} p ON q.edge_id = p.edge_id AND q.t * 1000 >= p.at_ms),
    fe AS (SELECT fb.event_id, fb.edge_id, fb.t, any_value(fb.v) + (fb.t - any_value(fb.x)) * (arg_min(p.val, p.at_ms) / 1000.0 - any_value(fb.v)) / (min(p.at_ms) / 1000.0 - any_value(fb.x)) AS f
      FROM fb JOIN {points} p ON p.edge_id = fb.edge_id AND p.at_ms > fb.at_ms GROUP BY fb.event_id, fb.edge_id, fb.t),
    gq AS (SELECT event_id, (edge_id + 1) % 50 AS edge_id, {shift} AS t, f FROM fe),
    gb AS (SELECT gq.*, p.at_ms / 1000.0 AS x, p.val / 1000.0 AS v, p.at_ms FROM gq ASOF JOIN {points} p ON gq.edge_id = p.edge_id AND gq.t * 1000 >= p.at_ms),
    ge AS (SELECT gb.event_id, any_value(gb.f) AS f, any_value(gb.v) + (any_value(gb.t) - any_value(gb.x)) * (arg_min(p.val, p.at_ms) / 1000.0 - any_value(gb.v)) / (min(p.at_ms) / 1000.0 - any_value(gb.x)) AS g
      FROM gb JOIN {points} p ON p.edge_id = gb.edge_id AND p.at_ms > gb.at_ms GROUP BY gb.event_id)"""


def _evaluated(t: Tables, how: str) -> DataFrame:
    h = kernels.combined(_pairs(t), "edge_id", how)
    d = t.departures.select("event_id", "edge_id", (F.col("t") / 1000).alias("t")).join(if_small(h, FUNCTIONS), "edge_id")
    return d.select("event_id", F.round(ttf.eval_s(F.col("h"), F.col("t")), 3).alias("tt"))


@query("F5_linked", "WITH " + _SECOND_EVAL.replace("{shift}", "(t + f) % 86400.0") + " SELECT event_id, CAST(round(f + g, 3) AS DOUBLE) AS tt FROM ge")
def _(t):
    return _evaluated(t, "link")


@query("F6_merged", "WITH " + _SECOND_EVAL.replace("{shift}", "t") + " SELECT event_id, CAST(round(least(f, g), 3) AS DOUBLE) AS tt FROM ge")
def _(t):
    return _evaluated(t, "merge")


@query("G13_G15_G16_hierarchy", f"{_ALL} SELECT q.query_id, q.source, q.target, CAST(d.d AS BIGINT) AS dist FROM ({_STQ}) q LEFT JOIN d5 d ON d.s = q.source AND d.v = q.target")
def _(t):
    graph = search.load_graph(t.edges)
    metric = hierarchy.Hierarchy(graph, hierarchy.min_degree_order(graph)).customize(perfect=True)
    return hierarchy.tree_distances(t.sql(_STQ), metric).select("query_id", "source", "target", "dist")


@query("G18_tree_labels", f"{_ALL} SELECT s AS source, v AS target, CAST(d AS BIGINT) AS dist FROM d5 WHERE s IN (SELECT tail FROM {{edges}} UNION SELECT head FROM {{edges}}) AND v IN (SELECT tail FROM {{edges}} UNION SELECT head FROM {{edges}})")
def _(t):
    graph = search.load_graph(t.edges)
    metric = hierarchy.Hierarchy(graph, hierarchy.min_degree_order(graph)).customize(perfect=True)
    nodes = t.edges.select(F.col("tail").alias("node")).union(t.edges.select("head")).distinct()
    pairs = nodes.select(F.col("node").alias("source")).crossJoin(F.broadcast(nodes.select(F.col("node").alias("target"))))
    out, into = (hierarchy.ancestor_labels(nodes, metric, forward) for forward in (True, False))
    return search.label_distances(pairs, out, into).select("source", "target", "dist")


@query("G22_alternatives")
def _(t):
    return routing.per_query(t.sql(_STQ).dropDuplicates(["source", "target"]), search.load_graph(t.edges), _alternatives)


def _alternatives(graph, source, target):
    return routing.penalty_alternatives(graph, source, target)


@query("F16_profiles")
def _(t):
    rows = t.hourly.select("edge_id", (F.col("at_ms") / 3_600_000).cast("int").alias("h"), (20 + F.col("val") % 80).cast("int").alias("speed"))
    g = rows.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("h", "speed"))).alias("p"))
    return profiles(g)


def profiles(g: DataFrame) -> DataFrame:
    """Travel-time profiles of hourly speeds (p: h, speed) on links of 500 m and more."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, ats, vals = [], [], []
            for e, p in zip(b.column("edge_id").to_pylist(), b.column("p").to_pylist(), strict=True):
                starts = [x["h"] * 3600 for x in p]
                starts[0] = 0
                at, val = kernels.profile_to_ttf(starts, [x["speed"] for x in p], 500 + 40 * e)
                ids += [e] * len(at)
                ats += at.round(3).tolist()
                vals += val.round(3).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(ats, pa.float64()), pa.array(vals, pa.float64())], names=["edge_id", "at_s", "val_s"])

    return g.mapInArrow(run, "edge_id int, at_s double, val_s double")


@query("F20_D6_calibration")
def _(t):
    m = t.measured.select("edge_id", F.least(F.col("sampled") / 4, F.lit(80.0)).alias("density"), F.greatest(F.lit(1.0), 60 - F.col("vehicles") * 1.5).alias("speed"), F.lit(60.0).alias("free_flow"))
    return kernels.calibrated(m, "edge_id").select("edge_id", *[F.round(c, 4).alias(c) for c in ("a", "e", "theta", "jam", "sse")])


@query("T1_T2_link_speeds")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.select(F.col("user_id").alias("vehicle_id"), F.row_number().over(w).alias("k"), "event_id")
    link = e.select("vehicle_id", (F.col("k") * 2).alias("seq"), F.lit("link").alias("kind"), F.col("k").cast("bigint").alias("link_id"), (10_000 + F.col("event_id") % 5 * 1000).cast("int").alias("length"), F.lit(50).alias("speed_limit"), F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("double").alias("fraction"))
    trace = e.select("vehicle_id", (F.col("k") * 2 + 1).alias("seq"), F.lit("trace").alias("kind"), F.col("k").cast("bigint").alias("link_id"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("speed_limit"), (100_000 + F.col("k") * 2000).cast("bigint").alias("ts"), F.lit(0.5).alias("fraction"))
    return link_speed.link_speeds(link.unionByName(trace))


@query("D1_D7_D11_assignment")
def _(t):
    def route(trips, weights):
        found = search.dijkstra(trips, search.load_graph(weights))
        return found.where("dist IS NOT NULL AND size(edge_path) > 0").select("query_id", F.col("edge_path").alias("path"), F.col("dist").cast("double").alias("cost"))

    def cost(chosen, weights):
        use = chosen.select(F.explode("path").alias("edge_id")).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
        slower = F.col("weight") + F.coalesce("n", F.lit(0)) / 4
        return weights.join(use, weights["edge_id"] == use["edge_id"], "left").select(weights["edge_id"], "tail", "head", slower.cast("bigint").alias("weight"))

    alternatives, _ = assignment.assign(t.sql(_STQ), route, cost, t.edges, 3)
    return alternatives.select("query_id", "alt_ix", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.round("cost", 4).alias("cost"), F.round("prob", 6).alias("prob"))


@query(
    "F27_merged_alternatives",
    """WITH f AS (SELECT l_orderkey AS query_id, l_partkey AS p, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey ELSE -1 END AS s, l_extendedprice / 2 AS cost FROM {lines} WHERE pos = 1),
    j AS (SELECT a.query_id, a.alt_ix, a.partkey, a.suppkey, a.prob, a.partkey = f.p AND a.suppkey = f.s AS same, CAST(a.cost AS DOUBLE) AS old, CAST(f.cost AS DOUBLE) AS new, f.p FROM {alternatives} a JOIN f ON f.query_id = a.query_id),
    k AS (SELECT *, bool_or(same) OVER (PARTITION BY query_id) AS known, count(*) OVER (PARTITION BY query_id) AS n FROM j)
    SELECT query_id, CAST(alt_ix AS INT) AS alt_ix, partkey || ' ' || suppkey AS path, round(CASE WHEN same THEN new ELSE old END, 3) AS cost, round(CASE WHEN known THEN prob ELSE prob * n / (n + 1) END::DOUBLE, 6) AS prob FROM k
    UNION ALL SELECT query_id, CAST(max(alt_ix) + 1 AS INT), any_value(p) || ' -1', round(any_value(new), 3), round(1.0 / (any_value(n) + 1)::DOUBLE, 6) FROM k WHERE NOT known GROUP BY query_id""",
)
def _(t):
    a = t.alternatives.groupBy("query_id", "alt_ix").agg(F.array(F.first("partkey"), F.first("suppkey")).alias("path"), F.first("cost").alias("cost"), F.first("prob").cast("double").alias("prob"))
    found = t.lines.where("pos = 1").select(F.col("l_orderkey").alias("query_id"), F.array("l_partkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey")).otherwise(F.lit(-1).cast("bigint"))).alias("path"), (F.col("l_extendedprice") / 2).alias("cost"))
    m = assignment.merge_new_paths(a, found)
    return m.select("query_id", "alt_ix", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.round("cost", 3).alias("cost"), F.round("prob", 6).alias("prob"))


@query(
    "S26_N13_log_state",
    """WITH l AS (SELECT 'f' || (user_id % 20) AS file, event_id AS line, event_id % 500 = 0 AS e, event_id % 500 <> 0 AND event_id % 50 = 1 AS s, event_id % 500 <> 0 AND event_id % 50 IN (2, 30) AS p FROM {events}),
    c AS (SELECT *, max(CASE WHEN e THEN line END) OVER w AS le, max(CASE WHEN s THEN line END) OVER w AS ls, max(CASE WHEN p THEN line END) OVER w AS lp FROM l WINDOW w AS (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING))
    SELECT file, line, '/x/run_' || le AS experiment, CAST(CASE WHEN ls >= coalesce(le, -1) THEN ls // 50 END AS INT) AS step,
      CASE WHEN ls >= coalesce(le, -1) AND lp >= coalesce(ls, -1) THEN CASE WHEN lp % 50 = 2 THEN 'router' ELSE 'simulation' END END AS part, CAST(NULL AS DOUBLE) AS rel_gap,
      CASE WHEN NOT (e OR s OR p) THEN 'phase' || (line % 7) END AS phase, CASE WHEN NOT (e OR s OR p) THEN line END AS phase_ns, CAST(NULL AS VARCHAR) AS duration FROM c""",
)
def _(t):
    text = F.when(F.col("event_id") % 500 == 0, F.format_string("Calling it with output directory: /x/run_%d and arguments: a", F.col("event_id")))
    text = text.when(F.col("event_id") % 50 == 1, F.format_string("> Executing step %d", F.floor(F.col("event_id") / 50))).when(F.col("event_id") % 50 == 2, F.lit(">> Running router"))
    text = text.when(F.col("event_id") % 50 == 30, F.lit(">> Running simulation")).otherwise(F.format_string("r; /x; 1; phase%d; %d", F.col("event_id") % 7, F.col("event_id")))
    return formats.carried(t.events.select(F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("file"), F.col("event_id").alias("line"), text.alias("value")))


# --- workloads ------------------------------------------------------------------------------


@query(
    "G7_components",
    """WITH RECURSIVE u AS (SELECT tail AS a, head AS b FROM {edges} UNION SELECT head, tail FROM {edges}), r(s, v) AS (SELECT a, a FROM u UNION SELECT r.s, u.b FROM r JOIN u ON u.a = r.v)
    SELECT s AS node, min(v) AS component FROM r GROUP BY s""",
)
def _(t):
    return workloads.components(t.edges)


@query("G33_uniform_queries", f"SELECT CAST(query_id AS BIGINT) AS query_id, {_draw('query_id', 7, 0)} % 25 AS source, {_draw('query_id', 7, 1)} % 25 AS target, {_draw('query_id', 7, 2)} % 86400000 AS departure FROM range(10000) AS r(query_id)")
def _(t):
    return workloads.uniform_queries(t.spark, 25, 10_000, 7, 86_400_000)


@query("G33_ball_queries", f"{_ALL}, r AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY d, v) AS k FROM d5) SELECT s AS source, v AS target FROM r WHERE k <= 6")
def _(t):
    return workloads.ball_queries(_distances(t), 6, 6, 1)


_WINDOWS = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(workloads.day_windows(3_600_000)))


@query(
    "G27_window_bounds",
    f"""WITH w(k, a, b) AS (VALUES {_WINDOWS}), seg AS (SELECT edge_id, at_ms AS a, val AS v, lead(at_ms) OVER w AS b, lead(val) OVER w AS u FROM {{points}} WINDOW w AS (PARTITION BY edge_id ORDER BY at_ms)),
    ends AS (SELECT s.edge_id, w.k, s.a + s.v + (x.at - s.a) * (s.b + s.u - s.a - s.v) // (s.b - s.a) - x.at AS v FROM w, LATERAL (SELECT unnest([w.a, w.b]) AS at) x JOIN seg s ON x.at >= s.a AND x.at < s.b),
    every AS (SELECT * FROM ends UNION ALL SELECT p.edge_id, w.k, p.val FROM w JOIN {{points}} p ON p.at_ms > w.a AND p.at_ms < w.b)
    SELECT edge_id, k, CAST(min(v) AS BIGINT) AS lo, CAST(max(v) AS BIGINT) AS hi FROM every GROUP BY edge_id, k""",
)
def _(t):
    return workloads.window_bounds(_functions(t), workloads.day_windows(3_600_000))


@query("G31_contracted_chains")
def _(t):
    # Each nation's way to its nearest neighbour.
    return workloads.contract_chains(t.edges.groupBy("tail").agg(F.min_by("head", F.struct("weight", "head")).alias("head"), F.min("weight").alias("weight")))


@query(
    "S7_live_overlay",
    """SELECT e.edge_id, l.live, CAST(l.duration + 1000 AS BIGINT) AS until FROM {edges} e LEFT JOIN (SELECT CAST(user_id % 225 AS INT) AS edge_id, CAST(floor(max(value)) AS BIGINT) AS live, CAST(max(event_id) % 5000 AS BIGINT) AS duration
      FROM {events} GROUP BY user_id % 225) l ON l.edge_id = e.edge_id AND l.duration < 4000""",
)
def _(t):
    live = t.events.groupBy((F.col("user_id") % 225).cast("int").alias("edge_id")).agg(F.floor(F.max("value")).cast("bigint").alias("live"), (F.max("event_id") % 5000).alias("duration"))
    return workloads.live_overlay(t.edges.select("edge_id"), live, 1000, 4000)[0]


@query("T5_periodic_buckets", "SELECT event_id, CAST((t // 900000) % 96 AS BIGINT) AS bucket FROM {departures}")
def _(t):
    return t.departures.select("event_id", F.pmod(F.floor(F.col("t") / 900_000), F.lit(96)).alias("bucket"))


@query("O7_first_queries", f"SELECT query_id, source, target FROM ({_STQ}) q ORDER BY query_id LIMIT 100")
def _(t):
    return t.sql(_STQ).orderBy("query_id").limit(100)


@query(
    "X22_known_ids",
    """SELECT count(*) AS total, count(*) FILTER (a AND b) AS nodes_known, count(*) FILTER (e) AS edge_known FROM (
      SELECT v.x IN (SELECT node_id FROM {places} WHERE region < 3) AS a, v.y IN (SELECT node_id FROM {places} WHERE region < 3) AS b,
        EXISTS (SELECT 1 FROM {edges} k WHERE k.tail = v.x AND k.head = v.y) AS e FROM (SELECT event_id % 30 AS x, user_id % 30 AS y FROM {events}) v) q""",
)
def _(t):
    inside = t.places.where("region < 3")
    v = t.events.select((F.col("event_id") % 30).alias("x"), (F.col("user_id") % 30).alias("y"))
    known = lambda name: inside.select(F.col("node_id").alias(name), F.lit(True).alias(f"k_{name}"))
    e = t.edges.select(F.col("tail").alias("x"), F.col("head").alias("y"), F.lit(True).alias("k_e"))
    j = v.join(known("x"), "x", "left").join(known("y"), "y", "left").join(e, ["x", "y"], "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("k_x") & F.col("k_y")).alias("nodes_known"), F.count_if("k_e").alias("edge_known"))


@query("X23_upscaled", "SELECT edge_id, at_ms * 10 AS at_ms, val * 10 AS val FROM {points}")
def _(t):
    return t.points.select("edge_id", (F.col("at_ms") * 10).alias("at_ms"), (F.col("val") * 10).alias("val"))


@query("P10_link_directions", "SELECT a.road_id, b.road_id AS opposite FROM {roads} a JOIN (SELECT tail, head, min(road_id) AS road_id FROM {roads} GROUP BY tail, head) b ON b.tail = a.head AND b.head = a.tail WHERE a.lanes > 2")
def _(t):
    first = t.roads.groupBy(F.col("head").alias("tail"), F.col("tail").alias("head")).agg(F.min("road_id").alias("opposite"))
    return t.roads.where("lanes > 2").join(first, ["tail", "head"]).select("road_id", "opposite")


@query("U2_active_edges", "SELECT DISTINCT edge_id FROM {hourly} WHERE at_ms < 36000000 UNION SELECT edge_id FROM {hourly} WHERE at_ms >= 57600000 AND val > 3000000")
def _(t):
    h = t.hourly
    return h.where("at_ms < 36000000").select("edge_id").union(h.where("at_ms >= 57600000 AND val > 3000000").select("edge_id")).distinct()


_P = "(1 / (1 + 0.2316419 * abs(z)))"


@query(
    "A13_paired_tests",
    f"""WITH r AS (SELECT algorithm, iteration, avg(value::DOUBLE) AS v FROM ({_RUNS}) x GROUP BY ALL), d AS (SELECT a.v - b.v AS d FROM r a JOIN r b ON a.iteration = b.iteration AND a.algorithm = 'F' AND b.algorithm = 'O'),
    k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0), w AS (SELECT count(*) AS m, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus FROM k),
    s AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d), z AS (SELECT *, (w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24) AS z FROM s, w)
    SELECT 'F-O' AS pair, n, round(mean, 5) AS mean, round(mean / sd, 7) AS cohen_d, round(mean / (sd / sqrt(n)), 7) AS t, CAST(w_plus AS DOUBLE) AS w_plus, round(z, 9) AS z,
      round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * {_P} * (0.319381530 + {_P} * (-0.356563782 + {_P} * (1.781477937 + {_P} * (-1.821255978 + {_P} * 1.330274429)))), 6) AS p_rank FROM z""",
)
def _(t):
    r = t.sql(_RUNS).groupBy("algorithm", "iteration").agg(F.avg(F.col("value").cast("double")).alias("v"))
    a, b = r.where("algorithm = 'F'").select("iteration", F.col("v").alias("a")), r.where("algorithm = 'O'").select("iteration", F.col("v").alias("b"))
    found = workloads.paired_tests(a.join(b, "iteration").withColumn("pair", F.lit("F-O")), ["pair"], "a", "b")
    return found.withColumns({c: F.round(c, k) for c, k in (("mean", 5), ("cohen_d", 7), ("t", 7), ("z", 9), ("p_rank", 6))})


@query("D13_random_trips", f"SELECT k || '-' || i AS id, {_draw('k', 'i', 5, 0)} % 25 AS source, {_draw('k', 'i', 5, 1)} % 25 AS target, CAST(k * 3600 + i * 3600 / n::DOUBLE AS DOUBLE) AS depart FROM (VALUES (0, 200), (1, 500), (2, 300)) AS p(k, n), range(500) AS r(i) WHERE i < n")
def _(t):
    return workloads.random_trips(t.places, {0: 200, 1: 500, 2: 300}, 3600, 5)


@query("D4_sampled_routes")
def _(t):
    def route(trips, weights):
        return search.dijkstra(trips, search.load_graph(weights)).where("dist IS NOT NULL").select("query_id", "dist", "edge_path")

    def update(found, weights):
        use = found.select(F.explode("edge_path").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
        return weights.join(use, weights["edge_id"] == use["e"], "left").select("edge_id", "tail", "head", (F.col("weight") + F.coalesce("n", F.lit(0))).alias("weight"))

    r = workloads.sampled_routes(t.sql(_STQ), [0.5, 0.3, 0.2], t.edges, route, update, 11)
    return r.select("query_id", "sample", "dist")


def _timed_graph(t: Tables):
    timed = t.edges.select((F.col("edge_id") % 50).cast("int").alias("f_id"), "edge_id").join(t.points.withColumnRenamed("edge_id", "f_id"), "f_id").select("edge_id", F.col("at_ms").alias("at"), "val")
    return search.load_graph(t.edges, timed)


def _timed_queries(t: Tables) -> DataFrame:
    return t.sql(_STQ).withColumn("departure", F.pmod(F.col("query_id") * 104729, F.lit(86_400_000)))


@query("G26_profiles")
def _(t):
    sources = t.places.select(F.col("node_id").cast("bigint").alias("source")).repartition(25)
    p = routing.profile_rows(sources, _timed_graph(t))
    return p.select("source", "node", F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"), "points")


@query("G23_sampled_windows")
def _(t):
    return routing.sampled_windows(_timed_queries(t), _timed_graph(t))


@query("G29_G30_traffic_aware")
def _(t):
    return routing.per_query(t.sql(_STQ).dropDuplicates(["source", "target"]), search.load_graph(t.edges), _aware)


def _aware(graph, source, target):
    """The route on live weights (a hash of the edge slows some down) near the smooth optimum."""
    live = [float(w * (1 + e * 7919 % 5)) for w, e in zip(graph.weight, graph.edge, strict=True)]
    aware = routing.TrafficAware(graph, live, 0.5)
    found = aware.fixed(source, target)
    if found is not None and not found[1]:  # still violating: the exact search decides
        found = aware.exact(source, target)
    if found is not None and not found[1]:
        raise RuntimeError(f"no route from {source} to {target} is proven after {aware.most} rounds")
    return [] if found is None else [found[0]]
