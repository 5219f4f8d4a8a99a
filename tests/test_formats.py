"""Readers and writers on small files, and one network from files to routes."""

import gzip

import numpy as np
import pyspark.sql.functions as F
import pytest

from routeloom.functions import roads, ttf
from routeloom.operators import measurements, network, search
from routeloom.sources import formats, sinks


@pytest.fixture(scope="module")
def net(tmp_path_factory):
    d = tmp_path_factory.mktemp("net")
    (d / "n.nod.xml").write_text('<nodes>\n<node id="v0" x="0" y="0"/><node id="v1" x="300" y="400"/>\n<node id="v2" x="300" y="550"/><node id="v3" x="300" y="700"/></nodes>')
    edges = ['<edge id="e0" from="v0" to="v1" priority="-1" numLanes="1" speed="5"/>', '<edge id="e1" from="v1" to="v2" priority="-2" numLanes="2" speed="2.5"><param key="capacity" value="77.5"/></edge>']
    edges += ['<edge id="e2" from="v1" to="v2" priority="-1" numLanes="0" speed="1.5"/>', '<edge id="e3" from="v2" to="v3" length="150"><lane index="0"><param key="a" value="b"/></lane></edge>']
    (d / "n.edg.xml").write_text("<edges>" + "\n".join(edges) + "</edges>")
    (d / "n.trips.xml").write_text('<trips><trip id="t" depart="30" from="e0" to="e3"/></trips>')
    rows = "".join(f'<edge id="e{k}" traveltime="{t}" overlapTraveltime="{t}" sampledSeconds="{s}"/>' for k, (t, s) in enumerate([(180, 6), (60, 0), (100, 3), (30, 1)]))
    (d / "dump.xml").write_text(f'<meandata><interval begin="0.00" end="60.00" id="a">{rows}</interval><interval begin="60.00" end="120.00" id="b"><edge id="e0" traveltime="120"/></interval></meandata>')
    return d


def test_network_to_route(spark, net):
    nodes, edges, trips = formats.nodes(spark, str(net / "n.nod.xml")), formats.edges(spark, str(net / "n.edg.xml")), formats.read_xml(spark, "trips", str(net / "n.trips.xml"))
    a = nodes.select(F.col("id").alias("from"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = edges.join(a, "from").join(b, "to")
    e = e.withColumn("length", roads.length_or_distance(F.col("length"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    e = network.weigh(e).withColumns({"tail": F.substring("from", 2, 9).cast("int"), "head": F.substring("to", 2, 9).cast("int")})
    e = network.dense_ids(e, ["tail", "head", "id"], "edge_id")
    got = {r.id: (r.edge_id, r.weight) for r in e.collect()}
    assert got == {"e0": (0, 100_000), "e1": (1, 60_000), "e2": (2, 100_000), "e3": (3, 10_791)}
    cap = {r.id: r.c for r in e.select("id", roads.capacity(F.col("lanes"), F.col("priority"), F.col("speed"), F.col("capacity")).alias("c")).collect()}
    assert cap == {"e0": 2000.0, "e1": 77.5, "e2": 0.0, "e3": 1583.0}
    ids = e.select("edge_id", "id", "tail", "head")
    t = trips.select(F.col("id").alias("trip_id"), F.col("from"), F.col("to"), "depart").join(ids.select(F.col("id").alias("from"), F.col("edge_id").alias("from_edge")), "from").join(ids.select(F.col("id").alias("to"), F.col("edge_id").alias("to_edge")), "to")
    r = search.dijkstra(network.trip_queries(t, ids), search.load_graph(e)).first()
    assert (r.source, r.target, r.departure, r.dist, r.edge_path) == (1, 2, 30_000, 60_000, [1])


def test_measurements(spark, net):
    m = formats.meandata(spark, str(net / "dump.xml"))
    assert m.count() == 5
    d = m.select("edge_id", roads.lane_density(F.col("sampledSeconds"), F.col("overlapTraveltime"), F.col("end") - F.col("begin"), F.lit(100.0), F.lit(2)).alias("d"))
    assert sorted((r.edge_id, round(r.d, 6)) for r in d.collect()) == [("e0", 0.0), ("e0", 0.5), ("e1", 0.0), ("e2", 0.25), ("e3", 0.083333)]
    f = measurements.fifo(spark.createDataFrame([(1, 0, 1_100_000), (1, 100_000, 1_000_000), (1, 200_000, 150_000)], "edge_id int, at bigint, val bigint"))
    assert [r.val for r in f.orderBy("at").collect()] == [350_000, 250_000, 150_000]


def test_routes_round_trip(spark, tmp_path):
    rows = [("a", 20.0, 1, 0, ["e0", "e1"], 5.0, 0.25), ("a", 20.0, 1, 1, ["e2"], 4.0, 0.75), ("b", 10.0, 0, 0, ["e3"], 1.0, 1.0)]
    alt = spark.createDataFrame(rows, "id string, depart double, last int, alt_ix int, edges array<string>, cost double, probability double")
    sinks.write_alternatives(alt, str(tmp_path / "alt"))
    back = formats.routes(spark, str(tmp_path / "alt"))
    assert sorted(tuple(r) for r in back.select(alt.columns).collect()) == sorted(rows)
    sinks.write_routes(alt.where("alt_ix = last").select("id", "depart", "edges"), str(tmp_path / "rou"))
    assert [(r.id, r.edges) for r in formats.routes(spark, str(tmp_path / "rou")).orderBy("depart").collect()] == [("b", ["e3"]), ("a", ["e2"])]


def test_text_formats(spark, tmp_path):
    (tmp_path / "g.tpgr").write_text("3 2 3 86400\n0 1 1\n0.0 10.0\n0 2 2\n0.0 20.0\n43200.0 25.5\n")
    g = formats.tpgr(spark, str(tmp_path / "g.tpgr")).orderBy("edge_id").collect()
    assert [(r.tail, r.head, [tuple(p) for p in r.f]) for r in g] == [(0, 1, [(0, 10_000)]), (0, 2, [(0, 20_000), (43_200_000, 25_500)])]
    e = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "edge_id int, tail int, head int")
    f = spark.createDataFrame([(0, 0, 10_000), (1, 0, 20_000), (1, 43_200_000, 25_500)], "edge_id int, at bigint, val bigint")
    lines = [r.value for r in sinks.tpgr_lines(e, f, 3).collect()]
    assert lines == ["3 2 3 86400", "0 1 1", "0.0 10.0", "0 2 2", "0.0 20.0", "43200.0 25.5"]
    with pytest.raises(Exception, match="period"):
        formats.tpgr(spark, str(tmp_path / "g.tpgr"), 1000)
    (tmp_path / "l.txt").write_text("52.52 13.405\n52.5 13.4\n")
    assert [(r.node_id, round(r.latitude, 3)) for r in formats.lat_lon(spark, str(tmp_path / "l.txt")).collect()] == [(0, 52.52), (1, 52.5)]
    with gzip.open(tmp_path / "gps.csv.gz", "wt") as out:
        out.write("timestampUTC_ms,mm_linkId,mm_speed_mps,mm_isFromRef\n5,100,10.0,true\n6,101,bad,false\n")
    assert [(r.link_id, r.speed_kmh, r.from_ref) for r in formats.gps_points(spark, str(tmp_path / "gps.csv.gz")).collect()] == [(100, 36.0, True), (101, 1000.0, False)]
    (tmp_path / "prof.csv").write_text("1,2,30,40,50\n3,4,7,7\n")
    assert [(r.osm_from, r.speeds) for r in formats.speed_profiles(spark, str(tmp_path / "prof.csv")).collect()] == [(1, [30, 40, 50]), (3, [7, 7])]
    (tmp_path / "ptv.csv").write_text("from;to;speed;distance;duration\n1;2;0;10;20\n2;3;50;10;20\n")
    assert [r.speed for r in formats.traffic_information(spark, str(tmp_path / "ptv.csv")).collect()] == [None, 50]
    (tmp_path / "exp.csv").write_text("# comment\nin;p;t;0;3600;900;0.1;0.01;50\nbroken;line\n")
    assert [(r.prefix, r.last_iter) for r in formats.experiments(spark, str(tmp_path / "exp.csv")).collect()] == [("p", 50)]
    (tmp_path / "r.json").write_text('{"algo_runs": [{"from": 1, "to": 2, "running_time_ms": 0.5, "result": 7},\n {"from": 2, "to": 3, "result": null}]}')
    assert [(r["from"], r.result) for r in formats.algo_runs(spark, str(tmp_path / "r.json")).collect()] == [(1, 7), (2, None)]


def test_rdf(spark, tmp_path):
    for name, text in (("rdf_link", "100\t1\t2\n101\t2\t3\n"), ("rdf_node", "1\t5212345\t1340000\t\n"), ("adas_link_geometry", "100\t0\t521234567\t134000000\t\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt.1").write_text(text)
    nav = [""] * 27
    nav[0], nav[4], nav[6], nav[19], nav[25] = "100", "3", "B", "5", "50"
    (tmp_path / "rdf_nav_link").mkdir()
    (tmp_path / "rdf_nav_link" / "rdf_nav_link.txt").write_text("\t".join(nav) + "\n")
    links = formats.rdf_links(spark, str(tmp_path)).join(formats.rdf_nav_links(spark, str(tmp_path)), "link_id")
    d = network.directed_links(links.select("link_id", "ref_node", "nonref_node", "direction", "from_ref_limit", "to_ref_limit"))
    assert sorted((r.way, r.tail, r["head"], r.from_ref_limit, r.to_ref_limit) for r in d.collect()) == [("F", 1, 2, 50, None), ("T", 2, 1, 50, None)]
    assert formats.rdf_nodes(spark, str(tmp_path)).first().lat == pytest.approx(52.12345)
    assert formats.rdf_geometries(spark, str(tmp_path)).first().lat == pytest.approx(52.1234567)


def test_vectors(spark, tmp_path):
    first, head, weight = [0, 2, 3, 3], [1, 2, 2], [5, 2_147_483_647, 7]
    for name, v in (("first_out", first), ("head", head), ("weight", weight)):
        np.array(v, "<u4").tofile(tmp_path / name)
    read = lambda n: formats.vector(spark, str(tmp_path / n), "u4")
    e = formats.csr_edges(read("first_out"), read("head"), read("weight")).orderBy("edge_id").collect()
    assert [(r.tail, r["head"], r.weight) for r in e] == [(0, 1, 5), (0, 2, None), (1, 2, 7)]
    parts = sinks.write_vector(read("weight"), str(tmp_path / "out"), "u4").orderBy("first").collect()
    assert b"".join(bytes(p.bytes) for p in parts) == np.array(weight, "<u4").tobytes()
    np.array([1 << 63, 5], "<u8").tofile(tmp_path / "big")
    assert [int(r.value) for r in formats.vector(spark, str(tmp_path / "big"), "u8").collect()] == [1 << 63, 5]


def test_other_writers(spark, tmp_path):
    e = spark.createDataFrame([(0, 0, 1, 10), (1, 1, 0, 4)], "edge_id int, tail int, head int, weight bigint")
    assert [r.value for r in sinks.dimacs_lines(e, 2).collect()] == ["p sp 2 2", "a 1 2 10", "a 2 1 4"]
    n = spark.createDataFrame([(0, 52.5, 13.25)], "node_id int, lat double, lon double")
    assert [r.value for r in sinks.coordinate_lines(n).collect()] == ["p aux sp co 1", "v 1 52500000 13250000"]
    assert 'freq="900"' in sinks.edge_data_file("x.xml", 0, 3600, 900)
    g = spark.createDataFrame([(1, 0.5), (0, 0.25)], "iteration int, gap double")
    assert [r.value for r in sinks.gap_lines(g).collect()] == ["0.250000000", "0.500000000"]
    sinks.write_lines(sinks.metric_lines(spark.createDataFrame([("x", "p", 1, "route", 5)], "executable string, path string, iteration int, phase string, nanos bigint")), str(tmp_path / "m"))
    m = spark.read.text(str(tmp_path / "m"))
    assert [r.value for r in m.collect()] == ["x; p; 1; route; 5"]
    c = spark.createDataFrame([("e0", "e1", "0", "0")], "from string, to string, fromLane string, toLane string")
    sinks.write_connections(c, str(tmp_path / "con"))
    assert formats.read_xml(spark, "connections", str(tmp_path / "con")).first().to == "e1"
    t = spark.createDataFrame([("t", "e0", "e1", 3.0)], "id string, from string, to string, depart double")
    sinks.write_trips(t, str(tmp_path / "tr"))
    assert formats.read_xml(spark, "trips", str(tmp_path / "tr")).first().depart == 3.0
    md = spark.createDataFrame([(0.0, 60.0, "e0", 5.0), (0.0, 60.0, "e1", 6.0)], "begin double, end double, edge_id string, traveltime double")
    sinks.write_meandata(md, str(tmp_path / "md"))
    assert sorted((r.edge_id, r.traveltime) for r in formats.meandata(spark, str(tmp_path / "md")).collect()) == [("e0", 5.0), ("e1", 6.0)]


def test_logs(spark, tmp_path):
    text = """Calling it with output directory: /x/run_1 and arguments: -l 3
> Executing step 0
>> Running router
>>> Duration: 0:00:01.500000
router; /x; 0; customization; 1200
<<
>> Running simulation
>>> Duration: 0:00:02.000000
< relative gap in iteration 0: 0.25
> Executing step 1
bin; /x; 1; routing; 99
Calling it with output directory: /x/run_2 and arguments: -l 3
"""
    (tmp_path / "a.out").write_text(text)
    rows = formats.log_steps(spark, str(tmp_path / "a.out")).collect()
    by = {r.line: r for r in rows}
    assert (by[4].step, by[4].part, by[4].phase, by[4].phase_ns) == (0, "router", "customization", 1200)
    assert (by[8].step, by[8].part, by[8].rel_gap) == (0, "simulation", 0.25)
    assert (by[10].step, by[10].part, by[10].phase_ns) == (1, None, 99)
    assert (by[11].experiment, by[11].step) == ("/x/run_2", None)


def test_matsim_and_ttf(spark, tmp_path):
    (tmp_path / "m.csv").write_text('tripId,legId,tripBeginTime,locationFrom,locationTo\n5,1,25:10:01,"(48.1,9.2: e7, 0.5)","(48.1,9.2: e8, 0.1)"\n')
    assert tuple(formats.matsim_trips(spark, str(tmp_path / "m.csv")).first()) == ("5-1", "e7", "e8", 90601.0)
    f = spark.createDataFrame([(1, 0, 5), (1, 10, 5)], "edge_id int, at bigint, val bigint").groupBy("edge_id").agg(ttf.collect().alias("f"))
    assert [tuple(p) for p in f.select(ttf.normalised(F.col("f"), 24).alias("f")).first().f] == [(0, 5)]


def test_more_formats(spark, tmp_path):
    (tmp_path / "m.txt").write_text("INVOCATION|Lee\nPARAMS|1.5,2\nDENSITIES|\nSPEEDS|\n\nINVOCATION|Lee\nPARAMS|3\nDENSITIES|1,2\nSPEEDS|30,20.5\n")
    got = formats.model_dump(spark, str(tmp_path / "m.txt")).orderBy("record").collect()
    assert [(r.model, r.params, r.densities, r.speeds) for r in got] == [("Lee", [1.5, 2.0], [], []), ("Lee", [3.0], [1.0, 2.0], [30.0, 20.5])]
    for name, v in (("source", [4, 5]), ("target", [6, 7])):
        np.array(v, "<u4").tofile(tmp_path / name)
    q = formats.query_set(spark, str(tmp_path), {"source": "u4", "target": "u4"})
    assert sorted(map(tuple, q.collect())) == [(0, 4, 6), (1, 5, 7)]
    for name, v in (("fp", [0, 1, 3]), ("at", [0, 0, 500]), ("val", [10, 20, 30])):
        np.array(v, "<u4").tofile(tmp_path / name)
    read = lambda n: formats.vector(spark, str(tmp_path / n), "u4")
    e = spark.createDataFrame([(0, 1, 2), (1, 2, 1)], "edge_id bigint, tail int, head int")
    t = {r.edge_id: [tuple(p) for p in r.f] for r in formats.td_edges(e, read("fp"), read("at"), read("val"), 1000.0).collect()}
    assert t == {0: [(0.0, 0.01)], 1: [(0.0, 0.02), (0.5, 0.03)]}
    (tmp_path / "n.txt").write_text("5\nx\n7\n")
    assert [r.value for r in formats.encoded(spark, str(tmp_path / "n.txt"), "int").orderBy("i").collect()] == [5, None, 7]
    sinks.write_tables({"e": e}, str(tmp_path / "obj"))
    assert formats.read_tables(spark, str(tmp_path / "obj"), ["e"])["e"].count() == 2
    sinks.write_report({"program": "x"}, e, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).where("program = 'x'").count() == 2
    links = spark.createDataFrame([(0, 9.5, 77, "F")], "edge_id bigint, length double, link_id bigint, direction string")
    assert [r.value for r in sinks.link_lines(e, links).collect()] == ["1,2,9.5,77,F"]
    d = spark.createDataFrame([(0, 1, 2, 1500, None)], "query_id int, source int, target int, departure bigint, rank int")
    assert [r.value for r in sinks.demand_lines(d).collect()] == ["1 1.500 2 0"]
    n = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 5.0)], "node_id int, lat double, lon double")
    assert sinks.box_edges(e, n, (0, 10), (0, 10)).count() == 2
