"""Sources and sinks: each format is written from the tables and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators import network
from routeloom.operators.tables import shared_dir
from routeloom.plans.registry import query
from routeloom.plans.tables import Tables
from routeloom.sources import formats, sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _text(t: Tables, lines: DataFrame, name: str, one: bool = False) -> str:
    """The folder that lines (value) are written to; ``one`` where their order makes the format."""
    path = _folder(t, name)
    (lines.coalesce(1) if one else lines).select("value").write.text(path)
    return path


def _vector(t: Tables, column: DataFrame, kind: str = "u4") -> DataFrame:
    return formats.vector_parts(sinks.write_vector(column, _folder(t, "vector"), kind), kind)


def _first_out(edges: DataFrame, nodes: int, tail: str = "tail") -> DataFrame:
    """Offsets (i, value) of a graph whose edges are numbered by tail: edges of all smaller tails."""
    n = edges.groupBy(tail).count()
    places = edges.sparkSession.range(nodes + 1).withColumnRenamed("id", "i")
    return places.join(n, F.col(tail) < F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("value"))


@query("S1_W1_vector", "SELECT CAST(edge_id AS BIGINT) AS i, weight AS value FROM {edges}")
def _(t):
    return _vector(t, t.edges.select(F.col("edge_id").alias("i"), F.col("weight").alias("value")))


@query("S2_W2_lines", "SELECT c_name AS value FROM {customer}")
def _(t):
    path = _folder(t, "lines")
    sinks.write_lines(t.customer.select(F.col("c_name").alias("value")), path)
    return t.spark.read.text(path)


@query("S3_W3_tables", "SELECT e.edge_id, e.weight, p.region FROM {edges} e JOIN {places} p ON p.node_id = e.tail")
def _(t):
    folder = _folder(t, "object")
    sinks.write_tables({"edges": t.edges, "places": t.places}, folder)
    back = formats.read_tables(t.spark, folder, ["edges", "places"])
    return back["edges"].join(back["places"], F.col("tail") == F.col("node_id")).select("edge_id", "weight", "region")


@query("S4_weighted_graph", "SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(tail AS BIGINT) AS tail, CAST(head AS BIGINT) AS head, CASE WHEN edge_id % 7 <> 0 THEN weight END AS weight FROM {edges}")
def _(t):
    e = t.edges.withColumn("w", F.when(F.col("edge_id") % 7 == 0, 2_147_483_647).otherwise(F.col("weight")))
    column = lambda c: e.select(F.col("edge_id").alias("i"), F.col(c).alias("value"))
    return formats.csr_edges(_vector(t, _first_out(e, 25)), _vector(t, column("head")), _vector(t, column("w")))


def _td_vectors(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Functions of the first 50 edges as vectors: first point of each edge, departures, values."""
    p = network.dense_ids(t.points, ["edge_id", "at_ms"], "i")
    first = _first_out(p, 50, "edge_id")
    return t.edges, _vector(t, first), _vector(t, p.select("i", F.col("at_ms").alias("value"))), _vector(t, p.select("i", F.col("val").alias("value")))


def _td_rows(found: DataFrame) -> DataFrame:
    return found.select("edge_id", "tail", "head", F.explode_outer("f").alias("p")).select("edge_id", "tail", "head", "p.at", "p.val")


@query("S5_td_graph", "SELECT e.edge_id, e.tail, e.head, p.at_ms AS at, p.val FROM {edges} e LEFT JOIN {points} p ON p.edge_id = e.edge_id")
def _(t):
    return _td_rows(formats.td_edges(*_td_vectors(t)))


@query("S6_td_graph_seconds", "SELECT e.edge_id, e.tail, e.head, CAST(p.at_ms / 1000.0 AS DOUBLE) AS at, CAST(p.val / 1000.0 AS DOUBLE) AS val FROM {edges} e LEFT JOIN {points} p ON p.edge_id = e.edge_id")
def _(t):
    return _td_rows(formats.td_edges(*_td_vectors(t), scale=1000.0))


def _xml(t: Tables, df: DataFrame, root: str, row: str) -> str:
    path = _folder(t, row)
    sinks._xml(df, path, root, row)
    return path


@query("S8_P4_nodes", "SELECT 'v' || node_id AS id, lon AS x, lat AS y, round(CAST(CAST(lat AS FLOAT) AS DOUBLE), 3) AS latitude, round(CAST(CAST(lon AS FLOAT) AS DOUBLE), 3) AS longitude FROM {places}")
def _(t):
    path = _xml(t, t.places.select(F.concat(F.lit("v"), "node_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y")), "nodes", "node")
    found = network.coordinates(formats.nodes(t.spark, path))
    return found.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("latitude", "longitude")})


@query("S9_edges", "SELECT 'e' || edge_id AS id, 'v' || tail AS \"from\", 'v' || head AS \"to\", edge_id % 4 AS lanes, CAST(CASE WHEN edge_id % 5 <> 0 THEN weight / 10.0 END AS DOUBLE) AS speed, CAST(weight * 2.0 AS DOUBLE) AS length, -(edge_id % 3) AS priority, CASE WHEN edge_id % 6 = 0 THEN CAST(weight AS VARCHAR) END AS capacity FROM {edges}")
def _(t):
    param = F.when(F.col("edge_id") % 6 == 0, F.array(F.struct(F.lit("note").alias("_key"), F.lit("x").alias("_value")), F.struct(F.lit("capacity").alias("_key"), F.col("weight").cast("string").alias("_value"))))
    e = t.edges.select(
        F.concat(F.lit("e"), "edge_id").alias("id"),
        F.concat(F.lit("v"), "tail").alias("from"),
        F.concat(F.lit("v"), "head").alias("to"),
        (F.col("edge_id") % 4).alias("numLanes"),
        F.when(F.col("edge_id") % 5 != 0, F.col("weight") / 10).alias("speed"),
        (F.col("weight") * 2.0).alias("length"),
        (-(F.col("edge_id") % 3)).alias("priority"),
        param.alias("param"),
    )
    return formats.edges(t.spark, _xml(t, e, "edges", "edge"))


@query("S10_W6_connections", "SELECT 'e' || a.edge_id AS \"from\", 'e' || b.edge_id AS \"to\", '0' AS \"fromLane\", CAST(b.edge_id % 3 AS VARCHAR) AS \"toLane\" FROM {edges} a JOIN {edges} b ON b.tail = a.head")
def _(t):
    a, b = t.edges.select(F.col("edge_id").alias("a"), F.col("head").alias("node")), t.edges.select(F.col("edge_id").alias("b"), F.col("tail").alias("node"))
    c = a.join(b, "node").select(F.concat(F.lit("e"), "a").alias("from"), F.concat(F.lit("e"), "b").alias("to"), F.lit("0").alias("fromLane"), (F.col("b") % 3).cast("string").alias("toLane"))
    path = _folder(t, "connections")
    sinks.write_connections(c, path)
    return formats.read_xml(t.spark, "connections", path)


@query("S11_W6_O5_trips", "SELECT 't' || o_orderkey AS id, 'e' || (o_custkey % 225) AS \"from\", 'e' || (o_orderkey % 225) AS \"to\", CAST(o_orderkey * 37 % 86400 AS DOUBLE) AS depart, CAST(row_number() OVER (ORDER BY o_orderkey * 37 % 86400, 't' || o_orderkey) AS INT) AS place FROM {orders} WHERE o_orderkey % 86400 < 86400")
def _(t):
    trip = t.orders.select(F.concat(F.lit("t"), "o_orderkey").alias("id"), F.concat(F.lit("e"), F.col("o_custkey") % 225).alias("from"), F.concat(F.lit("e"), F.col("o_orderkey") % 225).alias("to"), (F.col("o_orderkey") * 37 % 86400).cast("double").alias("depart"))
    path = _folder(t, "trips")
    sinks.write_trips(trip, path)
    back = formats.read_xml(t.spark, "trips", path).select("id", "from", "to", "depart")
    # The order in which a simulator takes them: by time, then id.
    return network.dense_ids(back, ["depart", "id"], "place").withColumn("place", (F.col("place") + 1).cast("int"))


_CLOCK = "lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ':00'"


@query("S12_matsim_trips", "SELECT 'p' || o_orderkey || '-' || '1' AS id, 'e' || (o_custkey % 225) AS \"from\", 'e' || (o_orderkey % 225) AS \"to\", CAST(o_orderkey % 30 * 3600 + o_custkey % 60 * 60 AS DOUBLE) AS depart FROM {orders}")
def _(t):
    place = lambda c: F.concat(F.lit("(52.5,13.4: e"), F.col(c) % 225, F.lit(", 0.5)"))
    rows = t.orders.select(F.concat(F.lit("p"), "o_orderkey").alias("tripId"), F.lit("1").alias("legId"), F.expr(_CLOCK.replace("VARCHAR", "STRING")).alias("tripBeginTime"), place("o_custkey").alias("locationFrom"), place("o_orderkey").alias("locationTo"))
    path = _folder(t, "matsim")
    rows.write.option("header", True).csv(path)
    return formats.matsim_trips(t.spark, path)


def _chosen(t: Tables) -> DataFrame:
    g = t.alternatives.select(F.concat(F.lit("q"), "query_id").alias("id"), (F.col("query_id") % 3600).cast("double").alias("depart"), F.lit(0).alias("last"), "alt_ix", F.array(F.concat(F.lit("p"), "partkey"), F.concat(F.lit("s"), "suppkey")).alias("edges"), F.col("cost").cast("double").alias("cost"), F.round("prob", 4).cast("double").alias("probability"))
    return g


@query("S13_W4_alternatives", "SELECT 'q' || query_id AS id, CAST(query_id % 3600 AS DOUBLE) AS depart, CAST(alt_ix AS INT) AS alt_ix, 0 AS last, 'p' || partkey || ' s' || suppkey AS edges, CAST(cost AS DOUBLE) AS cost, CAST(round(prob, 4) AS DOUBLE) AS probability FROM {alternatives}")
def _(t):
    path = _folder(t, "alternatives")
    sinks.write_alternatives(_chosen(t), path)
    return formats.routes(t.spark, path).withColumn("edges", F.array_join("edges", " "))


@query("W5_batches", "SELECT CAST(query_id % 4 AS INT) AS batch, 'q' || query_id AS id, CAST(query_id % 3600 AS DOUBLE) AS depart, 'p' || partkey || ' s' || suppkey AS edges FROM {alternatives} WHERE alt_ix = 0")
def _(t):
    path = _folder(t, "batches")
    sinks.write_batches(_chosen(t).where("alt_ix = 0").withColumn("batch", (F.substring("id", 2, 20).cast("bigint") % 4).cast("int")), path)
    parts = [formats.routes(t.spark, f"{path}/batch={k}").select(F.lit(k).alias("batch"), "id", "depart", F.array_join("edges", " ").alias("edges")) for k in range(4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("S14_W6_meandata", "SELECT CAST(begin_s AS DOUBLE) AS \"begin\", CAST(begin_s + 900 AS DOUBLE) AS \"end\", 'e' || edge_id AS edge_id, CAST(traveltime AS DOUBLE) AS traveltime, CAST(overlap_tt AS DOUBLE) AS \"overlapTraveltime\", CAST(sampled AS DOUBLE) AS \"sampledSeconds\" FROM {measured}")
def _(t):
    m = t.measured.select(F.col("begin_s").cast("double").alias("begin"), (F.col("begin_s") + 900).cast("double").alias("end"), F.concat(F.lit("e"), "edge_id").alias("edge_id"), *[F.col(a).cast("double").alias(b) for a, b in (("traveltime", "traveltime"), ("overlap_tt", "overlapTraveltime"), ("sampled", "sampledSeconds"))])
    path = _folder(t, "meandata")
    sinks.write_meandata(m, path)
    return formats.meandata(t.spark, path).select(*m.columns)


@query("S15_tripinfo", "SELECT 't' || o_orderkey AS id, CAST(o_orderkey % 3600 AS DOUBLE) AS depart, CAST(o_custkey * 1.5 AS DOUBLE) AS duration FROM {orders}")
def _(t):
    rows = t.orders.select(F.concat(F.lit("t"), "o_orderkey").alias("id"), (F.col("o_orderkey") % 3600).cast("double").alias("depart"), (F.col("o_custkey") * 1.5).cast("double").alias("duration"))
    return formats.read_xml(t.spark, "tripinfo", _xml(t, rows, "tripinfos", "tripinfo"))


@query(
    "S16_rdf",
    """SELECT c_custkey AS link_id, c_custkey * 2 AS ref_node, c_custkey * 2 + 1 AS nonref_node, CASE WHEN c_custkey % 9 <> 0 THEN CAST(1 + c_custkey % 5 AS INT) END AS functional_class, CASE c_custkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'F' ELSE 'T' END AS direction,
      CAST(c_custkey % 8 AS INT) AS speed_category, CAST(c_custkey % 130 AS INT) AS from_ref_limit, CAST(NULL AS INT) AS to_ref_limit, CAST(round((4000000 + c_custkey * 2) / 1e5, 5) AS DOUBLE) AS lat, CAST(round((400000000 + c_custkey * 2) / 1e7, 7) AS DOUBLE) AS shape_lat FROM {customer}""",
)
def _(t):
    c, folder = t.customer, _folder(t, "rdf")
    k = F.col("c_custkey")
    empty = F.lit("")

    def put(name: str, fields: list) -> None:
        c.select(F.concat_ws("\t", *[F.coalesce(x.cast("string"), empty) for x in fields]).alias("value")).write.text(f"{folder}/{name}/{name}.txt")

    put("rdf_link", [k, k * 2, k * 2 + 1])
    nav = [empty] * 27
    nav[0], nav[4], nav[6], nav[19], nav[25] = k, F.when(k % 9 != 0, 1 + k % 5), F.when(k % 3 == 0, "B").when(k % 3 == 1, "F").otherwise("T"), k % 8, k % 130
    put("rdf_nav_link", nav)
    put("rdf_node", [k * 2, 4_000_000 + k * 2, 700_000 + k])
    put("adas_link_geometry", [k, F.lit(0), 400_000_000 + k * 2, 70_000_000 + k])
    links = formats.rdf_links(t.spark, folder).join(formats.rdf_nav_links(t.spark, folder), "link_id")
    nodes = formats.rdf_nodes(t.spark, folder).select(F.col("node_id").alias("ref_node"), F.round("lat", 5).alias("lat"))
    shapes = formats.rdf_geometries(t.spark, folder).select("link_id", F.round("lat", 7).alias("shape_lat"))
    return links.join(nodes, "ref_node").join(shapes, "link_id")


@query("S17_gps_points", "SELECT CAST(user_id AS BIGINT) AS link_id, event_id % 2 = 0 AS from_ref, CAST(CASE WHEN event_id % 11 = 0 THEN 1000.0 ELSE round(event_id % 40 * 3.6, 6) END AS DOUBLE) AS speed_kmh, CAST(event_id * 1000 AS BIGINT) AS ts FROM {events}")
def _(t):
    e = t.events
    speed = F.when(F.col("event_id") % 11 == 0, "bad").otherwise((F.col("event_id") % 40).cast("string"))
    rows = e.select((F.col("event_id") * 1000).alias("timestampUTC_ms"), F.lit("x").alias("other"), F.col("user_id").alias("mm_linkId"), speed.alias("mm_speed_mps"), (F.col("event_id") % 2 == 0).alias("mm_isFromRef"))
    path = _folder(t, "gps")
    rows.write.options(header=True, compression="gzip").csv(path)
    return formats.gps_points(t.spark, path).withColumn("speed_kmh", F.round("speed_kmh", 6))


@query("S18_speed_profiles", "SELECT CAST(c_custkey AS BIGINT) AS osm_from, CAST(c_custkey * 3 AS BIGINT) AS osm_to, CAST(c_custkey % 130 AS VARCHAR) || ' ' || CAST(c_custkey % 7 AS VARCHAR) || ' ' || CAST(c_nationkey AS VARCHAR) AS speeds FROM {customer}")
def _(t):
    k = F.col("c_custkey")
    path = _text(t, t.customer.select(F.concat_ws(",", k, k * 3, k % 130, k % 7, "c_nationkey").alias("value")), "profiles")
    return formats.speed_profiles(t.spark, path).withColumn("speeds", F.array_join(F.transform("speeds", lambda x: x.cast("string")), " "))


@query("S19_live_speeds", "SELECT CAST(event_id AS BIGINT) AS osm_from, CAST(user_id AS BIGINT) AS osm_to, CAST(event_id % 130 AS INT) AS speed FROM {events}")
def _(t):
    path = _folder(t, "live")
    t.events.select("event_id", "user_id", (F.col("event_id") % 130).cast("int").alias("speed")).write.csv(path)
    return formats.live_speeds(t.spark, path)


@query("S20_traffic_information", "SELECT tail AS \"from\", head AS \"to\", CAST(nullif(weight % 5, 0) AS INT) AS speed, CAST(weight AS INT) AS distance, CAST(edge_id AS INT) AS duration FROM {edges}")
def _(t):
    path = _folder(t, "ti")
    t.edges.select(F.col("tail").alias("from"), F.col("head").alias("to"), (F.col("weight") % 5).alias("speed"), F.col("weight").alias("distance"), F.col("edge_id").alias("duration")).write.options(header=True, sep=";").csv(path)
    return formats.traffic_information(t.spark, path)


@query("S21_W9_text_graph", "SELECT CAST(dense_rank() OVER (ORDER BY e.edge_id) - 1 AS INT) AS edge_id, CAST(e.tail AS INT) AS tail, CAST(e.head AS INT) AS head, CAST(trunc(p.at_ms / 1000.0::DOUBLE * 1000) AS BIGINT) AS at, CAST(trunc(p.val / 1000.0::DOUBLE * 1000) AS BIGINT) AS val FROM {edges} e JOIN {points} p ON p.edge_id = e.edge_id")
def _(t):
    p = t.points.select("edge_id", F.col("at_ms").alias("at"), "val")
    path = _text(t, sinks.tpgr_lines(t.edges.select("edge_id", "tail", "head"), p, 25), "tpgr", one=True)
    return _td_rows(formats.tpgr(t.spark, path))


@query("W9_binary_graph", "SELECT section, i, k, value FROM (SELECT 0 AS section, CAST(0 AS BIGINT) AS i, 0 AS k, CAST(2 AS BIGINT) AS value UNION ALL SELECT 0, 0, 1, 25 UNION ALL SELECT 0, 0, 2, count(*) FROM {edges} UNION ALL SELECT 0, 0, 3, count(*) FROM {points} UNION ALL SELECT 0, 0, 4, 86400000 UNION ALL SELECT 1, n.node_id, 0, (SELECT count(*) FROM {edges} e WHERE e.tail < n.node_id) FROM {places} n UNION ALL SELECT 2, edge_id, 0, head FROM {edges} UNION ALL SELECT 2, e.edge_id, 1, (SELECT count(*) FROM {points} p WHERE p.edge_id < e.edge_id) FROM {edges} e UNION ALL SELECT 3, row_number() OVER (ORDER BY edge_id, at_ms) - 1, 0, at_ms FROM {points} UNION ALL SELECT 3, row_number() OVER (ORDER BY edge_id, at_ms) - 1, 1, val FROM {points}) x")
def _(t):
    p = network.dense_ids(t.points, ["edge_id", "at_ms"], "i")
    first = _first_out(p, 225, "edge_id").select(F.col("i").cast("int").alias("edge_id"), F.col("value").alias("first_point"))
    return sinks.tbgr(_first_out(t.edges, 25), t.edges.join(first, "edge_id"), p.select("i", F.col("at_ms").alias("at"), "val"), 86_400_000)


@query("W9_demands", "SELECT c_nationkey || ' ' || printf('%.3f', (c_custkey * 1000 % 86400000) / 1000.0) || ' ' || (c_custkey * 7 % 25) || ' 0' AS value FROM {customer}")
def _(t):
    q = t.customer.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("source"), (F.col("c_custkey") * 7 % 25).alias("target"), (F.col("c_custkey") * 1000 % 86_400_000).alias("departure"), F.lit(None).cast("int").alias("rank"))
    return t.spark.read.text(_text(t, sinks.demand_lines(q), "demands"))


@query("W9_query_lines", "SELECT c_nationkey || ' ' || (c_custkey * 1000 % 86400000) || ' ' || (c_custkey * 7 % 25) AS value FROM {customer}")
def _(t):
    q = t.customer.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("source"), (F.col("c_custkey") * 7 % 25).alias("target"), (F.col("c_custkey") * 1000 % 86_400_000).alias("departure"))
    return t.spark.read.text(_text(t, sinks.query_lines(q), "queries"))


@query("S22_lat_lon", "SELECT node_id, round(CAST(CAST(lat AS FLOAT) AS DOUBLE), 3) AS latitude, round(CAST(CAST(lon AS FLOAT) AS DOUBLE), 3) AS longitude FROM {places}")
def _(t):
    lines = t.places.orderBy("node_id").select(F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"))
    found = formats.lat_lon(t.spark, _text(t, lines, "latlon", one=True))
    return found.withColumns({c: F.round(F.col(c).cast("double"), 3) for c in ("latitude", "longitude")})


@query("S23_D2_query_set", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS query_id, CAST(c_nationkey AS BIGINT) AS source_node, CAST(c_custkey * 1000 % 86400000 AS BIGINT) AS source_time, CAST(c_custkey * 7 % 25 AS BIGINT) AS target_node FROM {customer}")
def _(t):
    q = network.dense_ids(t.customer, ["c_custkey"], "i")
    folder = _folder(t, "queries")
    for name, c in (("source_node", F.col("c_nationkey")), ("source_time", F.col("c_custkey") * 1000 % 86_400_000), ("target_node", F.col("c_custkey") * 7 % 25)):
        sinks.write_vector(q.select("i", c.alias("value")), f"{folder}/{name}", "u4")
    return formats.query_set(t.spark, folder, {"source_node": "u4", "source_time": "u4", "target_node": "u4"}, parts=True)


_RANKED = "SELECT node_id, CAST((node_id * 7 + 3) % 25 AS INT) AS rank FROM {places}"


@query(
    "S24_potential_graph",
    f"""WITH r AS ({_RANKED}), e AS (SELECT a.rank AS t, b.rank AS h, min(e.weight) AS weight FROM {{edges}} e JOIN r a ON a.node_id = e.tail JOIN r b ON b.node_id = e.head GROUP BY a.rank, b.rank)
    SELECT x.forward, CAST(x.low AS BIGINT) AS tail, CAST(x.high AS BIGINT) AS head, x.weight, CAST(a.node_id AS BIGINT) AS tail_node, CAST(b.node_id AS BIGINT) AS head_node
    FROM (SELECT true AS forward, t AS low, h AS high, weight FROM e WHERE t < h UNION ALL SELECT false, h, t, weight FROM e WHERE h < t) x JOIN r a ON a.rank = x.low JOIN r b ON b.rank = x.high""",
)
def _(t):
    ranks = t.sql(_RANKED)
    e = network.permute(t.edges, ranks).groupBy("tail", "head").agg(F.min("weight").alias("weight"))
    vectors = {"order": _vector(t, ranks.select(F.col("rank").alias("i"), F.col("node_id").alias("value")))}
    for side, rows in (("forward", e.where("tail < head")), ("backward", e.where("head < tail").select(F.col("head").alias("tail"), F.col("tail").alias("head"), "weight"))):
        placed = network.dense_ids(rows, ["tail", "head"], "i")
        vectors[f"{side}_first_out"] = _vector(t, _first_out(placed, 25))
        for part in ("head", "weight"):
            vectors[f"{side}_{part}"] = _vector(t, placed.select("i", F.col(part).alias("value")))
    return formats.potential_graph(vectors)


@query("S25_W13_report", "SELECT CAST(c_nationkey AS INT) AS \"from\", CAST(c_custkey * 7 % 25 AS INT) AS \"to\", CAST(NULL AS BIGINT) AS at, CAST(c_custkey / 4.0 AS DOUBLE) AS running_time_ms, CAST(c_custkey AS BIGINT) AS result FROM {customer}")
def _(t):
    runs = t.customer.select(F.col("c_nationkey").cast("int").alias("from"), (F.col("c_custkey") * 7 % 25).cast("int").alias("to"), (F.col("c_custkey") / 4).alias("running_time_ms"), F.col("c_custkey").cast("bigint").alias("result"))
    path = _folder(t, "report")
    sinks.write_contexts({"program": "queries", "seed": 7}, {"algo_runs": runs, "graph": t.edges.groupBy("tail").count()}, path)
    return formats.algo_runs(t.spark, path)


@query("S27_experiments", "SELECT 'in' || c_custkey AS in_dir, 'p' AS prefix, 't' AS trip_file, CAST(0 AS DOUBLE) AS \"begin\", CAST(3600 AS DOUBLE) AS \"end\", CAST(900 AS DOUBLE) AS aggregation, CAST(0.1 AS DOUBLE) AS conv_deviation, CAST(c_custkey / 8.0 AS DOUBLE) AS conv_relgap, CAST(c_custkey % 50 AS INT) AS last_iter FROM {customer} WHERE c_custkey % 10 > 1")
def _(t):
    k = F.col("c_custkey")
    whole = F.concat_ws(";", F.concat(F.lit("in"), k), F.lit("p;t;0;3600;900;0.1"), (k / 8).cast("string"), (k % 50).cast("string"))
    line = F.when(k % 10 == 0, F.concat(F.lit("# note "), k)).when(k % 10 == 1, F.lit("broken;line")).otherwise(whole)
    return formats.experiments(t.spark, _text(t, t.customer.select(line.alias("value")), "experiments"))


@query("S28_model_dump", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS record, 'm' || c_custkey AS model, c_nationkey || '.5' AS params, c_custkey || '.0 1.0' AS densities, '' AS speeds FROM {customer}")
def _(t):
    k = F.col("c_custkey").cast("string")
    four = F.array(F.concat(F.lit("INVOCATION|m"), k), F.concat(F.lit("PARAMS|"), F.col("c_nationkey"), F.lit(".5,")), F.concat(F.lit("DENSITIES|"), k, F.lit(".0,1.0")), F.lit("SPEEDS|"))
    lines = t.customer.select("c_custkey", F.posexplode(four).alias("k", "value")).orderBy("c_custkey", "k").select("value")
    found = formats.model_dump(t.spark, _text(t, lines, "dump", one=True))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return found.select("record", "model", joined("params"), joined("densities"), joined("speeds"))


@query("S29_encoded", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS i, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey AS BIGINT) END AS value FROM {customer}")
def _(t):
    k = F.col("c_custkey")
    lines = t.customer.orderBy(k).select(F.when(k % 10 == 0, "none").otherwise(k.cast("string")).alias("value"))
    return formats.encoded(t.spark, _text(t, lines, "numbers", one=True), "bigint")


@query("W7_edge_data", "SELECT '    <edgeData id=\"dump_900\" freq=\"900\" file=\"dump.xml\" begin=\"0\" end=\"3600\" excludeEmpty=\"true\"/>' AS value")
def _(t):
    text = sinks.edge_data_file("dump.xml", 0, 3600, 900)
    lines = t.spark.createDataFrame([(x,) for x in text.strip().split("\n")], "value string")
    return t.spark.read.text(_text(t, lines, "additional")).where(F.col("value").contains("edgeData"))


@query("W8_dimacs", "SELECT 'p sp 25 ' || count(*) AS value FROM {edges} UNION ALL SELECT 'a ' || (tail + 1) || ' ' || (head + 1) || ' ' || weight FROM {edges} UNION ALL SELECT 'p aux sp co ' || count(*) FROM {places} UNION ALL SELECT 'v ' || (node_id + 1) || ' ' || CAST(trunc(lat * 1000000) AS BIGINT) || ' ' || CAST(trunc(lon * 1000000) AS BIGINT) FROM {places}")
def _(t):
    return t.spark.read.text(_text(t, sinks.dimacs_lines(t.edges, 25), "gr")).unionByName(t.spark.read.text(_text(t, sinks.coordinate_lines(t.places), "co")))


@query("W10_link_lines", "SELECT tail || ',' || head || ',' || (weight * 2) || ',' || (edge_id * 10) || ',' || CASE WHEN edge_id % 2 = 0 THEN 'F' ELSE 'T' END AS value FROM {edges} WHERE edge_id % 9 <> 0")
def _(t):
    e = t.edges.select("edge_id", "tail", "head", (F.col("weight") * 2).alias("length"))
    links = t.edges.where("edge_id % 9 <> 0").select("edge_id", (F.col("edge_id") * 10).alias("link_id"), F.when(F.col("edge_id") % 2 == 0, "F").otherwise("T").alias("direction"))
    return t.spark.read.text(_text(t, sinks.link_lines(e, links), "links"))


@query("W11_gap_lines", "SELECT printf('%.9f', weight / 1000.0) AS value FROM {edges}")
def _(t):
    return t.spark.read.text(_text(t, sinks.gap_lines(t.edges.select(F.col("edge_id").alias("iteration"), (F.col("weight") / 1000).alias("gap"))), "gaps"))


@query("W12_phase_lines", "SELECT 'router; /x; ' || edge_id || '; phase' || (edge_id % 3) || '; ' || (weight * 1000) AS value FROM {edges}")
def _(t):
    rows = t.edges.select(F.lit("router").alias("executable"), F.lit("/x").alias("path"), F.col("edge_id").alias("iteration"), F.concat(F.lit("phase"), F.col("edge_id") % 3).alias("phase"), (F.col("weight") * 1000).alias("nanos"))
    return t.spark.read.text(_text(t, sinks.metric_lines(rows), "phases"))


_BOX = "a.lat BETWEEN 42 AND 47 AND a.lon BETWEEN 6 AND 12 OR b.lat BETWEEN 42 AND 47 AND b.lon BETWEEN 6 AND 12"


@query("W14_box_edges", f"SELECT e.edge_id, e.tail, e.head, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM {{edges}} e JOIN {{places}} a ON a.node_id = e.tail JOIN {{places}} b ON b.node_id = e.head WHERE {_BOX}")
def _(t):
    return sinks.box_edges(t.edges, t.places, (42, 47), (6, 12)).select("edge_id", "tail", "head", "lat1", "lon1", "lat2", "lon2")


@query("W15_latex_table", r"SELECT 'l\_returnflag & n & quantity \\ \midrule' AS value UNION ALL SELECT l_returnflag || '\_' || l_linestatus || ' & ' || count(*) || ' & ' || CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) || ' \\' FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
def _(t):
    g = t.lineitem.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("l_returnflag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    return sinks.latex_lines(g, ["l_returnflag", "n", "quantity"], ["l_returnflag"])
