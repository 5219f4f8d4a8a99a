"""Readers of the formats that networks, feeds and logs come in.

Every reader has a fixed schema, so that ids stay text and nothing is inferred; files are
globbed and split by Spark's own sources, whatever store they are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.operators import network

_PARAM = "array<struct<_key:string,_value:string>>"
_ROUTE = "struct<_edges:string,_cost:double,_probability:double>"

#: Row tag and schema of each XML file; attributes carry an underscore.
XML = {
    "nodes": ("node", "_id string, _x double, _y double"),
    "edges": ("edge", f"_id string, _from string, _to string, _numLanes int, _speed double, _length double, _priority int, lane array<struct<_index:int,_length:double,_speed:double,param:{_PARAM}>>, param {_PARAM}"),
    "connections": ("connection", "_from string, _to string, _fromLane string, _toLane string"),
    "trips": ("trip", "_id string, _from string, _to string, _depart double, _departLane string, _departPos string, _departSpeed string"),
    "routes": ("vehicle", f"_id string, _depart double, route {_ROUTE}, routeDistribution struct<_last:int,route:array<{_ROUTE}>>"),
    "meandata": (
        "interval",
        "_id string, _begin double, _end double, edge array<struct<_id:string,_traveltime:double,_overlapTraveltime:double,_density:double,_speed:double,"
        "_sampledSeconds:double,_laneDensity:double,_departed:int,_arrived:int,_entered:int,_left:int>>",
    ),
    "tripinfo": ("tripinfo", "_id string, _depart double, _duration double"),
}


def read_xml(spark: SparkSession, kind: str, path: str) -> DataFrame:
    tag, schema = XML[kind]
    raw = spark.read.format("xml").options(rowTag=tag, attributePrefix="_", mode="FAILFAST").schema(schema).load(path)
    return raw.select(*[F.col(c).alias(c.removeprefix("_")) for c in raw.columns])


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, "nodes", path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """id, from, to, lanes, speed, length, priority, capacity (text of the edge's parameter)."""
    e = read_xml(spark, "edges", path)
    given = F.try_element_at(F.filter("param", lambda p: p["_key"] == "capacity"), F.lit(1))["_value"]
    return e.select("id", "from", "to", F.col("numLanes").alias("lanes"), "speed", "length", "priority", given.alias("capacity"))


def meandata(spark: SparkSession, path: str) -> DataFrame:
    """One row per interval and edge."""
    m = read_xml(spark, "meandata", path).select("begin", "end", F.explode("edge").alias("e"))
    names = [f.name for f in m.schema["e"].dataType.fields]
    return m.select("begin", "end", *[F.col(f"e.{n}").alias("edge_id" if n == "_id" else n.removeprefix("_")) for n in names])


def routes(spark: SparkSession, path: str) -> DataFrame:
    """One row per vehicle and route: id, depart, alt_ix, last (the choice), edges, cost, probability."""
    r = read_xml(spark, "routes", path)
    several = F.coalesce(F.col("routeDistribution.route"), F.array("route"))
    each = r.select("id", "depart", F.coalesce("routeDistribution._last", F.lit(0)).alias("last"), F.posexplode(several).alias("alt_ix", "r"))
    return each.select("id", "depart", "alt_ix", "last", F.split("r._edges", " ").alias("edges"), F.col("r._cost").alias("cost"), F.col("r._probability").alias("probability"))


def matsim_trips(spark: SparkSession, path: str) -> DataFrame:
    """trip-leg id, from, to and departure in seconds, from clock times and located edges."""
    from routeloom.functions import roads

    t = spark.read.options(header=True).schema("tripId string, legId string, tripBeginTime string, locationFrom string, locationTo string").csv(path)
    return t.select(
        F.concat_ws("-", "tripId", "legId").alias("id"),
        roads.located_edge(F.col("locationFrom")).alias("from"),
        roads.located_edge(F.col("locationTo")).alias("to"),
        roads.seconds_of(F.col("tripBeginTime")).alias("depart"),
    )


def _fields(spark: SparkSession, path: str, places: dict[str, tuple[int, str]]) -> DataFrame:
    """Fields of tab-separated lines by place, without quotes; unread numbers are null."""
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path)
    return lines.select(*[F.try_element_at(parts, F.lit(k + 1)).try_cast(kind).alias(name) for name, (k, kind) in places.items()])


def rdf_links(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(spark, f"{folder}/rdf_link/rdf_link.txt*", {"link_id": (0, "bigint"), "ref_node": (1, "bigint"), "nonref_node": (2, "bigint")})


def rdf_nav_links(spark: SparkSession, folder: str) -> DataFrame:
    places = {"link_id": (0, "bigint"), "functional_class": (4, "int"), "direction": (6, "string"), "speed_category": (19, "int"), "from_ref_limit": (25, "int"), "to_ref_limit": (26, "int")}
    return _fields(spark, f"{folder}/rdf_nav_link/rdf_nav_link.txt*", places)


def rdf_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates in 1e-5 degrees become degrees."""
    n = _fields(spark, f"{folder}/rdf_node/rdf_node.txt*", {"node_id": (0, "bigint"), "lat": (1, "bigint"), "lon": (2, "bigint"), "z": (3, "bigint")})
    return n.withColumns({"lat": F.col("lat") / 1e5, "lon": F.col("lon") / 1e5})


def rdf_geometries(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates in 1e-7 degrees become degrees."""
    g = _fields(spark, f"{folder}/adas_link_geometry/adas_link_geometry.txt*", {"link_id": (0, "bigint"), "seq": (1, "bigint"), "lat": (2, "bigint"), "lon": (3, "bigint"), "z": (4, "bigint")})
    return g.withColumns({"lat": F.col("lat") / 1e7, "lon": F.col("lon") / 1e7})


def gps_points(spark: SparkSession, path: str) -> DataFrame:
    """Columns by their header, in any order; an unread speed is 1000 km/h, which no filter passes."""
    wanted = {"mm_linkId": "bigint", "mm_isFromRef": "boolean", "mm_speed_mps": "double", "timestampUTC_ms": "bigint"}
    raw = spark.read.options(header=True).csv(path)
    p = raw.select(*[F.col(n).try_cast(k).alias(n) for n, k in wanted.items()])
    kmh = F.coalesce(F.col("mm_speed_mps") * 3.6, F.lit(1000.0))
    return p.select(F.col("mm_linkId").alias("link_id"), F.col("mm_isFromRef").alias("from_ref"), kmh.alias("speed_kmh"), F.col("timestampUTC_ms").alias("ts"))


def speed_profiles(spark: SparkSession, path: str) -> DataFrame:
    """from, to and the list of speeds that fills the rest of the line."""
    v = F.split("value", ",")
    return spark.read.text(path).where(F.col("value").rlike(r"^\d+,\d+,")).select(v[0].cast("bigint").alias("osm_from"), v[1].cast("bigint").alias("osm_to"), F.transform(F.slice(v, 3, 1 << 20), lambda x: x.try_cast("int")).alias("speeds"))


def live_speeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("osm_from bigint, osm_to bigint, speed int").csv(path).where("osm_from IS NOT NULL")


def traffic_information(spark: SparkSession, path: str) -> DataFrame:
    """from;to;speed;distance;duration; a speed of 0 means closed: null."""
    t = spark.read.options(sep=";", header=True).schema("from int, to int, speed int, distance int, duration int").csv(path)
    return t.withColumn("speed", F.nullif("speed", F.lit(0)))


def lat_lon(spark: SparkSession, path: str) -> DataFrame:
    """node_id by line number from 0, latitude, longitude."""
    numbered = numbered_lines(spark, path)
    v = F.split(F.trim("value"), r"\s+")
    return numbered.where("value <> ''").select(F.col("line").cast("int").alias("node_id"), v[0].cast("float").alias("latitude"), v[1].cast("float").alias("longitude"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 0 in their file, for files whose order counts.

    A file's splits are read by different tasks and numbered by themselves; only one count for each
    meets in a window.
    """
    place = {"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"), "_i": F.monotonically_increasing_id()}
    raw = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r$", "").alias("value"), *[c.alias(n) for n, c in place.items()])
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    splits = splits.select(F.col("_f").alias("_g"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i"))
    each = raw.withColumn("_own", own).join(F.broadcast(splits), (F.col("_f") == F.col("_g")) & (F.col("_b") == F.col("_c")))
    return each.select((F.col("_base") + F.col("_own") - 1).cast("int").alias("line"), "value")


def tpgr(spark: SparkSession, path: str, period: int = 86_400) -> DataFrame:
    """Text graphs: header 'n m p period', then for each edge 'tail head k' and k lines 'at val'.

    An edge line has three words, a point line two, so a running count of edge lines gives
    each point its edge without a parser's state. Times become milliseconds.
    """
    lines = numbered_lines(spark, path).where("value <> ''").withColumn("w", F.split(F.trim("value"), r"\s+"))
    header = lines.where("line = 0").select(F.assert_true(F.try_element_at("w", F.lit(4)).cast("int") == period, F.lit("another period")).alias("ok"))
    header.collect()
    body = lines.where("line > 0").withColumn("edge_id", F.count_if(F.size("w") == 3).over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ends = body.where("size(w) = 3").select(F.col("edge_id").cast("int").alias("edge_id"), F.col("w")[0].cast("int").alias("tail"), F.col("w")[1].cast("int").alias("head"))
    ms = lambda c: (c.cast("double") * 1000).cast("bigint")
    points = body.where("size(w) = 2").groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct(ms(F.col("w")[0]).alias("at"), ms(F.col("w")[1]).alias("val")))).alias("f"))
    return ends.join(points, "edge_id", "left")


def vector(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A raw little-endian column file: index and value. ``kind`` is a numpy type, such as u4."""
    import numpy as np
    import pyarrow as pa

    dtype = np.dtype("<" + kind)
    spark_kind = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "decimal(20,0)", "f4": "float", "f8": "double"}[kind]
    target = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}[spark_kind]

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                v = np.frombuffer(data, dtype)
                for at in range(0, len(v), 1 << 16):
                    part = v[at : at + (1 << 16)]
                    values = pa.array([int(x) for x in part], target) if spark_kind == "decimal(20,0)" else pa.array(part.astype(target.to_pandas_dtype()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), values], names=["i", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"i bigint, value {spark_kind}")


def vector_parts(parts: DataFrame, kind: str) -> DataFrame:
    """Index and value from parts of a vector (first, bytes), as ``sinks.write_vector`` leaves them."""
    import numpy as np
    import pyarrow as pa

    dtype = np.dtype("<" + kind)

    def run(batches):
        for b in batches:
            for first, data in zip(b.column("first").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                v = np.frombuffer(data, dtype)
                for at in range(0, len(v), 1 << 16):
                    part = v[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part))), pa.array(part.astype(float if dtype.kind == "f" else np.int64))], names=["i", "value"])

    return parts.mapInArrow(run, f"i bigint, value {'double' if dtype.kind == 'f' else 'bigint'}")


def _ranges(first: DataFrame, name: str) -> DataFrame:
    """``name``, a, b: each place of an offset vector with its value and the next place's."""
    after = first.select((F.col("i") - 1).alias("j"), F.col("value").alias("b"))
    return first.join(after, F.col("i") == F.col("j")).where("b > value").select(F.col("i").alias(name), F.col("value").alias("a"), "b")


def csr_edges(first_out: DataFrame, head: DataFrame, weight: DataFrame) -> DataFrame:
    """Edges of a compressed graph from its vectors (i, value): the tail of edge e is the node
    whose range of first_out holds e."""
    each = _ranges(first_out, "tail").select("tail", F.explode(F.sequence("a", F.col("b") - 1)).alias("edge_id"))
    h, w = head.select(F.col("i").alias("edge_id"), F.col("value").alias("head")), weight.select(F.col("i").alias("edge_id"), F.col("value").alias("weight"))
    return each.join(h, "edge_id").join(w, "edge_id").select("edge_id", "tail", "head", F.when(F.col("weight") != 2_147_483_647, F.col("weight")).alias("weight"))


_EXPERIMENT = {"in_dir": "string", "prefix": "string", "trip_file": "string", "begin": "double", "end": "double", "aggregation": "double", "conv_deviation": "double", "conv_relgap": "double", "last_iter": "int"}


def _experiments(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.col("value").startswith("#"))
    parts = F.split("value", ";")
    rows = lines.select("value", F.size(parts).alias("fields"), *[F.try_element_at(parts, F.lit(k + 1)).try_cast(kind).alias(n) for k, (n, kind) in enumerate(_EXPERIMENT.items())])
    numbers = [F.col(n).isNotNull() for n, kind in _EXPERIMENT.items() if kind != "string"]
    complete = F.col("fields") == len(_EXPERIMENT)
    for c in numbers:
        complete = complete & c
    return rows.withColumn("complete", complete)


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """Instances of an experiment: nine fields by ';', '#' for comments. Incomplete lines are left
    out; ``rejected_experiments`` has them."""
    return _experiments(spark, path).where("complete").select(*_EXPERIMENT)


def rejected_experiments(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``experiments`` leaves out, as they stand."""
    return _experiments(spark, path).where("NOT complete").select("value")


def potential_graph(vectors: dict[str, DataFrame]) -> DataFrame:
    """A hierarchy for potentials from its vectors (i, value): forward and backward edges (forward,
    tail, head, weight) between ranks, with the nodes that ``order`` puts at these ranks."""
    out = None
    for side in ("forward", "backward"):
        e = csr_edges(*(vectors[f"{side}_{part}"] for part in ("first_out", "head", "weight"))).select(F.lit(side == "forward").alias("forward"), "tail", "head", "weight")
        out = e if out is None else out.unionByName(e)
    at = lambda name: vectors["order"].select(F.col("i").alias(name), F.col("value").alias(f"{name}_node"))
    return out.join(at("tail"), "tail").join(at("head"), "head")


def algo_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the reports' ``algo_runs``."""
    run = T.StructType.fromDDL("`from` int, `to` int, `at` bigint, running_time_ms double, result bigint")
    raw = spark.read.option("multiLine", True).schema(T.StructType([T.StructField("algo_runs", T.ArrayType(run))])).json(path)
    return raw.select(F.inline("algo_runs"))


def log_steps(spark: SparkSession, path: str) -> DataFrame:
    """Lines of assignment logs with what they belong to: experiment, step, part and kind.

    The state that a line-by-line parser would carry is a window's last value by line.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return carried(lines)


def carried(lines: DataFrame) -> DataFrame:
    """``lines`` (file, line, value) with experiment, step and part carried forward.

    A new experiment forgets the step, and a new step the part.
    """
    v = F.col("value")
    group = lambda pattern, k=1: F.nullif(F.regexp_extract(v, pattern, k), F.lit(""))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    start = group(r"output directory:\s*(\S+)\s+and arguments:")
    step = group(r"^\s*>\s*Executing step\s+(\d+)\s*$").cast("int")
    part = F.when(v.rlike(r"^\s*>>\s*Running router\b"), "router").when(v.rlike(r"^\s*>>\s*Running simulation\b"), "simulation")
    c = lines.withColumns({"_e": start, "_s": step, "_p": part})
    at = lambda name: F.last(F.when(F.col(name).isNotNull(), F.struct("line", name)), True).over(w)
    c = c.withColumns({"_le": at("_e"), "_ls": at("_s"), "_lp": at("_p")})
    in_step = F.col("_ls.line") >= F.coalesce(F.col("_le.line"), F.lit(-1))
    in_part = F.col("_lp.line") >= F.coalesce(F.col("_ls.line"), F.lit(-1))
    gap = group(r"^\s*<\s*relative gap in iteration.*?:\s*(.+?)\s*$").try_cast("double")
    phase = F.when(v.rlike(r"^\s*[^;]+;\s*[^;]+;\s*-?\d+;\s*[^;]+;\s*\d+\s*$"), F.transform(F.split(v, ";"), lambda x: F.trim(x)))
    duration: Column = group(r"^\s*>>>\s*Duration:\s*(.+?)\s*$")
    return c.select(
        "file",
        "line",
        F.col("_le._e").alias("experiment"),
        F.when(in_step, F.col("_ls._s")).alias("step"),
        F.when(in_step & in_part, F.col("_lp._p")).alias("part"),
        gap.alias("rel_gap"),
        phase[3].alias("phase"),
        phase[4].cast("bigint").alias("phase_ns"),
        duration.alias("duration"),
    )


def model_dump(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines (INVOCATION, PARAMS, DENSITIES, SPEEDS): record, model and lists.

    A running count of first lines gives each line its record.
    """
    kv = F.split(F.trim("value"), r"\|", 2)
    lines = numbered_lines(spark, path).where(F.col("value").contains("|")).select("line", kv[0].alias("key"), kv[1].alias("rest"))
    lines = network.running_sum(lines.withColumn("first", (F.col("key") == "INVOCATION").cast("bigint")), "line", "first", "before").withColumn("record", F.col("before") + F.col("first") - 1)
    numbers = lambda key: F.transform(F.filter(F.split(F.max(F.when(F.col("key") == key, F.col("rest"))), ","), lambda x: x != ""), lambda x: x.cast("double"))
    model = F.max(F.when(F.col("key") == "INVOCATION", F.col("rest")))
    return lines.groupBy("record").agg(model.alias("model"), numbers("PARAMS").alias("params"), numbers("DENSITIES").alias("densities"), numbers("SPEEDS").alias("speeds"))


def query_set(spark: SparkSession, folder: str, names: dict[str, str], parts: bool = False) -> DataFrame:
    """Queries from a folder of raw column files (or of their ``parts``): query_id and a column for
    each file's type."""
    out = None
    for name, kind in names.items():
        read = vector_parts(spark.read.parquet(f"{folder}/{name}"), kind) if parts else vector(spark, f"{folder}/{name}", kind)
        c = read.select(F.col("i").alias("query_id"), F.col("value").alias(name))
        out = c if out is None else out.join(c, "query_id")
    return out


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """An object that is stored as one Parquet table per part."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def td_edges(edges: DataFrame, first_point: DataFrame, at: DataFrame, val: DataFrame, scale: float | None = None) -> DataFrame:
    """Edges with travel-time functions from vectors (i, value): points of edge e are those in
    its range of ``first_point``. ``scale`` divides both columns, as 1000 does for seconds."""
    each = _ranges(first_point, "edge_id").select("edge_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("k"))
    cut = lambda df, name: df.select(F.col("i").alias("k"), (F.col("value") / scale if scale else F.col("value")).alias(name))
    points = each.join(cut(at, "at"), "k").join(cut(val, "val"), "k")
    f = points.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("at", "val"))).alias("f"))
    return edges.join(f, "edge_id", "left")


def encoded(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Numbers, one a line, as a column with its place; what is no number is null."""
    return numbered_lines(spark, path).where("value <> ''").select(F.col("line").cast("bigint").alias("i"), F.trim("value").try_cast(kind).alias("value"))
