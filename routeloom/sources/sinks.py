"""Writers: tables to the formats of simulators and other routers, by Spark's own sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _xml(df: DataFrame, path: str, root: str, row: str) -> None:
    attributes = df.select(*[F.col(c).alias(f"_{c}") if not _nested(df, c) else F.col(c) for c in df.columns])
    attributes.write.format("xml").options(rootTag=root, rowTag=row, attributePrefix="_", declaration="").mode("overwrite").save(path)


def _nested(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("struct", "array")


def write_routes(chosen: DataFrame, path: str) -> None:
    """Vehicles (id, depart, edges) with one route, in the order of departure by milliseconds."""
    ordered = chosen.orderBy((F.col("depart") * 1000).cast("bigint"), "id")
    _xml(ordered.select("id", "depart", F.struct(F.array_join("edges", " ").alias("_edges")).alias("route")), path, "routes", "vehicle")


def write_alternatives(alternatives: DataFrame, path: str) -> None:
    """Vehicles (id, depart, last, alt_ix, edges, cost, probability) with all their routes."""
    route = F.struct("alt_ix", F.array_join("edges", " ").alias("_edges"), F.col("cost").alias("_cost"), F.col("probability").alias("_probability"))
    g = alternatives.groupBy("id", "depart", "last").agg(F.transform(F.sort_array(F.collect_list(route)), lambda r: F.struct(r["_edges"].alias("_edges"), r["_cost"].alias("_cost"), r["_probability"].alias("_probability"))).alias("r"))
    ordered = g.orderBy((F.col("depart") * 1000).cast("bigint"), "id")
    _xml(ordered.select("id", "depart", F.struct(F.col("last").alias("_last"), F.col("r").alias("route")).alias("routeDistribution")), path, "routes", "vehicle")


def write_batches(chosen: DataFrame, path: str) -> None:
    """Vehicles (batch, id, depart, edges) as one folder of routes for each batch of a simulation.

    A large batch's vehicles are cut into files by departure, whose names are in this order."""
    ordered = chosen.orderBy("batch", (F.col("depart") * 1000).cast("bigint"), "id")
    rows = ordered.select("batch", F.col("id").alias("_id"), F.col("depart").alias("_depart"), F.struct(F.array_join("edges", " ").alias("_edges")).alias("route"))
    rows.write.format("xml").options(rootTag="routes", rowTag="vehicle", attributePrefix="_", declaration="").partitionBy("batch").mode("overwrite").save(path)


def write_trips(trips: DataFrame, path: str) -> None:
    _xml(trips.orderBy("depart", "id"), path, "trips", "trip")


def write_connections(connections: DataFrame, path: str) -> None:
    _xml(connections, path, "connections", "connection")


def write_meandata(measured: DataFrame, path: str) -> None:
    """Intervals with their edges; a group is one interval's edges."""
    names = [c for c in measured.columns if c not in ("begin", "end", "edge_id")]
    e = F.struct(F.col("edge_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in names])
    g = measured.groupBy("begin", "end").agg(F.sort_array(F.collect_list(e)).alias("edge"))
    _xml(g.orderBy("begin"), path, "meandata", "interval")


def edge_data_file(output: str, begin: float, end: float, period: float) -> str:
    """The simulator's additional file that asks for measurements of edges."""
    return f'<additional>\n    <edgeData id="dump_{period:g}" freq="{period:g}" file="{output}" begin="{begin:g}" end="{end:g}" excludeEmpty="true"/>\n</additional>\n'


def dimacs_lines(edges: DataFrame, nodes: int) -> DataFrame:
    """The lines of a .gr file, header first; nodes count from 1."""
    n = edges.count()
    head = edges.sparkSession.createDataFrame([(0, f"p sp {nodes} {n}")], "k int, value string")
    body = edges.select(F.lit(1).alias("k"), F.format_string("a %d %d %d", F.col("tail") + 1, F.col("head") + 1, "weight").alias("value"), "tail", "head", "edge_id")
    return head.select("k", "value", *[F.lit(-1).alias(c) for c in ("tail", "head", "edge_id")]).unionByName(body).orderBy("k", "tail", "head", "edge_id").select("value")


def coordinate_lines(nodes: DataFrame) -> DataFrame:
    """The lines of a .co file: millionths of degrees, cut."""
    n = nodes.count()
    cut = lambda c: (F.col(c) * 1_000_000).cast("int")
    head = nodes.sparkSession.createDataFrame([(-1, f"p aux sp co {n}")], "k bigint, value string")
    return head.unionByName(nodes.select(F.col("node_id").cast("bigint").alias("k"), F.format_string("v %d %d %d", F.col("node_id") + 1, cut("lat"), cut("lon")).alias("value"))).orderBy("k").select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_vector(column: DataFrame, path: str, kind: str) -> DataFrame:
    """Raw little-endian parts of a column (i, value) in order: part number and bytes.

    Each range-sorted partition becomes one part; laid end to end they are the vector's file.
    """
    import numpy as np

    n = int(column.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first = [], None
        for b in batches:
            if first is None and len(b):
                first = b.column("i")[0].as_py()
            parts.append(np.asarray(b.column("value").to_numpy(zero_copy_only=False)).astype("<" + kind).tobytes())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([b"".join(parts)], pa.binary())], names=["first", "bytes"])

    out = column.select(F.col("i").cast("bigint").alias("i"), "value").repartitionByRange(n, "i").sortWithinPartitions("i").mapInArrow(run, "first bigint, bytes binary")
    out.write.mode("overwrite").parquet(path)
    return out.sparkSession.read.parquet(path)


def tpgr_lines(edges: DataFrame, functions: DataFrame, nodes: int, period: int = 86_400) -> DataFrame:
    """Lines of a text graph with travel-time functions (edge_id, at, val in ms), seconds out."""
    points = functions.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("at", "val"))).alias("f"))
    e = edges.join(points, "edge_id")
    m, p = e.count(), functions.count()
    head = edges.sparkSession.createDataFrame([(-1, 0, f"{nodes} {m} {p} {period}")], "edge_id bigint, k int, value string")
    first = e.select(F.col("edge_id").cast("bigint").alias("edge_id"), F.lit(0).alias("k"), F.format_string("%d %d %d", "tail", "head", F.size("f")).alias("value"))
    rest = e.select(F.col("edge_id").cast("bigint").alias("edge_id"), F.posexplode("f").alias("k", "x")).select("edge_id", F.col("k") + 1, F.format_string("%s %s", F.col("x.at") / 1000, F.col("x.val") / 1000).alias("value"))
    return head.union(first).union(rest).orderBy("edge_id", "k").select("value")


def tbgr(first_out: DataFrame, edges: DataFrame, points: DataFrame, period: int) -> DataFrame:
    """The binary graph with travel-time functions, as numbers (section, i, k, value) in its order.

    ``first_out`` has i and value; edges edge_id, head and first_point; points i, at and val. All are
    signed 32-bit numbers: five of the header, a node's first edge, an edge's head and first point,
    and a point's departure and travel time.
    """
    spark = edges.sparkSession
    head = [2, first_out.count() - 1, edges.count(), points.count(), period]
    top = spark.createDataFrame([(0, 0, k, v) for k, v in enumerate(head)], "section int, i bigint, k int, value bigint")
    pair = lambda df, section, key, a, b: df.select(F.lit(section).alias("section"), F.col(key).cast("bigint").alias("i"), F.posexplode(F.array(F.col(a).cast("bigint"), F.col(b).cast("bigint"))).alias("k", "value"))
    nodes = first_out.where(F.col("i") < head[1]).select(F.lit(1).alias("section"), F.col("i").cast("bigint").alias("i"), F.lit(0).alias("k"), F.col("value").cast("bigint").alias("value"))
    return top.unionByName(nodes).unionByName(pair(edges, 2, "edge_id", "head", "first_point")).unionByName(pair(points, 3, "i", "at", "val"))


def query_lines(queries: DataFrame) -> DataFrame:
    """Lines 'source departure target' of a query set, by query."""
    return queries.orderBy("query_id").select(F.format_string("%d %d %d", "source", "departure", "target").alias("value"))


def latex_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The body of a LaTeX table: a heading, then a line for each row in order; cells are escaped."""
    escape = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("--")), r"([&%$#_{}])", r"\\$1")
    head = rows.sparkSession.createDataFrame([(" & ".join(c.replace("_", r"\_") for c in columns) + r" \\ \midrule",)], "value string").select(F.lit(0).alias("part"), F.lit(None).alias("key"), "value")
    body = rows.select(F.lit(1).alias("part"), F.struct(*order).alias("key"), F.concat(F.concat_ws(" & ", *[escape(F.col(c)) for c in columns]), F.lit(r" \\")).alias("value"))
    return head.select("part", F.lit(None).cast(body.schema["key"].dataType).alias("key"), "value").unionByName(body).orderBy("part", "key").select("value")


def write_contexts(values: dict[str, object], contexts: dict[str, DataFrame], path: str) -> None:
    """A report as one JSON object: the run's values, and an array of rows for each context.

    Meant for measured runs, some thousands of rows; each context meets in one row.
    """
    spark = next(iter(contexts.values())).sparkSession
    out = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    for name, rows in contexts.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))))
    out.coalesce(1).write.mode("overwrite").json(path)


def metric_lines(rows: DataFrame) -> DataFrame:
    """Phase lines 'executable; path; iteration; phase; nanoseconds'."""
    return rows.select(F.concat_ws("; ", "executable", "path", F.col("iteration").cast("string"), "phase", F.col("nanos").cast("string")).alias("value"))


def gap_lines(gaps: DataFrame) -> DataFrame:
    """Relative gaps by iteration with nine decimals."""
    w = Window.orderBy("iteration")
    return gaps.withColumn("_k", F.row_number().over(w)).orderBy("_k").select(F.format_string("%.9f", "gap").alias("value"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """An object as one Parquet table per part."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_report(values: dict[str, object], runs: DataFrame, path: str) -> None:
    """A report as JSON lines: the run's values beside each of its measured rows."""
    named = [F.lit(v).alias(k) for k, v in values.items()]
    runs.select(*named, *runs.columns).write.mode("overwrite").json(path)


def link_lines(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Lines 'tail,head,length,linkId,direction' of edges and the links they come from."""
    j = edges.join(links, "edge_id")
    text = F.concat_ws(",", *[F.col(c).cast("string") for c in ("tail", "head", "length", "link_id", "direction")])
    return j.orderBy("edge_id").select(text.alias("value"))


def demand_lines(queries: DataFrame) -> DataFrame:
    """Lines 'source time target rank' of a query set, by query; times in seconds."""
    text = F.format_string("%d %.3f %d %d", "source", F.col("departure") / 1000, "target", F.coalesce("rank", F.lit(0)))
    return queries.orderBy("query_id").select(text.alias("value"))


def box_edges(edges: DataFrame, nodes: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """What a map of a box draws: edges with an end in it, and both ends' coordinates."""
    a = nodes.select(F.col("node_id").alias("tail"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("node_id").alias("head"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    inside = lambda k: F.col(f"lat{k}").between(*lat) & F.col(f"lon{k}").between(*lon)
    return edges.join(a, "tail").join(b, "head").where(inside(1) | inside(2))
