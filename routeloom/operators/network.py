"""Relational operators on road networks: ids, filters, expansions, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import chance, roads
from routeloom.operators.tables import written


def weigh(edges: DataFrame) -> DataFrame:
    """Edges with default speed and weight in ms (length, speed)."""
    v = roads.speed_or_default(F.col("speed"))
    return edges.withColumn("weight", roads.weight_ms(F.col("length"), v))


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 0 in the order of some columns.

    A global order takes one task in a plain window; here rows are range-partitioned and
    sorted, partitions are counted, and each row's number is its partition's offset plus its
    place, so that only one count per partition meets in one task.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    # Written, so that what is counted and what is numbered are the same partitions.
    placed = written(placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "placed")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), placed["_p"] == base["_q"]).withColumn(name, F.col("_base") + F.col("_r") - 1).drop("_p", "_r", "_q", "_base")


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, by ``order``: range partitions are
    summed by themselves, and one number for each meets in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()), "placed")
    own = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_n"))
    base = sums.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    whole = placed.withColumn("_r", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return whole.join(F.broadcast(base), F.col("_p") == F.col("_q")).withColumn(name, F.col("_base") + F.col("_r")).drop("_p", "_q", "_r", "_base")


def coordinates(nodes: DataFrame) -> DataFrame:
    """Nodes (id, x, y) with latitude from y and longitude from x, in single precision."""
    return nodes.withColumns({"latitude": F.col("y").cast("float"), "longitude": F.col("x").cast("float")})


def reachable_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """The view of a graph without edges whose weight is infinite, which is null in tables."""
    return edges.where(F.col(weight).isNotNull())


def tails(first_out: DataFrame) -> DataFrame:
    """edge_id and tail from a node's first edge and degree (``csr``)."""
    return first_out.where("degree > 0").select(F.explode(F.sequence("first_out", F.col("first_out") + F.col("degree") - 1)).alias("edge_id"), F.col("node_id").alias("tail"))


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edge ids: the place in the order of tail, head and then the rest that is given."""
    return dense_ids(edges, ["tail", "head"], "edge_id")


def trip_queries(trips: DataFrame, edges: DataFrame) -> DataFrame:
    """Trips (trip_id, from_edge, to_edge, depart in s) to node queries: source is the head of
    the first edge, target the tail of the last; departure in ms. Inner: unknown edges drop."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("head").alias("source"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("tail").alias("target"))
    return trips.join(a, "from_edge").join(b, "to_edge").select("trip_id", "source", "target", (F.col("depart") * 1000).cast("bigint").alias("departure"))


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that a strict join would lose; an empty result licenses the join."""
    return left.join(right, on, "left_anti")


def csr(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, degree and first_out: the number of edges before the node's first."""
    degree = edges.groupBy(F.col("tail").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    d = nodes.select("node_id").join(degree, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("degree"))
    return running_sum(d, "node_id", "degree", "first_out")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Without loops, and of parallel edges the least weight."""
    return edges.where("tail <> head").groupBy("tail", "head").agg(F.min("weight").alias("weight"))


def unify_parallel(edges: DataFrame) -> DataFrame:
    """Every parallel edge with the least weight of its group."""
    return edges.withColumn("weight", F.min("weight").over(Window.partitionBy("tail", "head")))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"tail": F.col("head"), "head": F.col("tail")})


def permute(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Nodes renamed to their ranks (node_id, rank)."""
    a = order.select(F.col("node_id").alias("tail"), F.col("rank").alias("r_tail"))
    b = order.select(F.col("node_id").alias("head"), F.col("rank").alias("r_head"))
    rest = [c for c in edges.columns if c not in ("tail", "head")]
    return edges.join(a, "tail").join(b, "head").select(F.col("r_tail").alias("tail"), F.col("r_head").alias("head"), *rest)


def split_by_rank(edges: DataFrame) -> DataFrame:
    """Edges of a permuted graph as (low, high, up): up if the tail has the lower rank."""
    return edges.where("tail <> head").withColumns({"up": F.col("tail") < F.col("head"), "low": F.least("tail", "head"), "high": F.greatest("tail", "head")})


def line_graph(edges: DataFrame, turn_cost: Column, forbidden: DataFrame | None = None) -> DataFrame:
    """Turns as edges between edges: from_edge, to_edge, weight of the first plus the turn.

    ``turn_cost`` is an expression over e1.* and e2.*; null forbids the turn, as do the rows
    of ``forbidden`` (from_edge, to_edge).
    """
    t = edges.alias("e1").join(edges.alias("e2"), F.col("e1.head") == F.col("e2.tail"))
    t = t.select(F.col("e1.edge_id").alias("from_edge"), F.col("e2.edge_id").alias("to_edge"), (F.col("e1.weight") + turn_cost).alias("weight")).where("weight IS NOT NULL")
    return t if forbidden is None else t.join(forbidden, ["from_edge", "to_edge"], "left_anti")


def u_turn(penalty: int) -> Column:
    return F.when((F.col("e1.tail") == F.col("e2.head")) & (F.col("e1.head") == F.col("e2.tail")), penalty).otherwise(0)


def bounding_box(edges: DataFrame, nodes: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """The subgraph within a box, with nodes numbered anew (node, from node_id)."""
    inside = nodes.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    numbered = dense_ids(inside, ["node_id"], "node")
    a = numbered.select(F.col("node_id").alias("tail"), F.col("node").alias("new_tail"))
    b = numbered.select(F.col("node_id").alias("head"), F.col("node").alias("new_head"))
    rest = [c for c in edges.columns if c not in ("tail", "head")]
    return numbered, edges.join(a, "tail").join(b, "head").select(F.col("new_tail").alias("tail"), F.col("new_head").alias("head"), *rest)


def expand_connections(edges: DataFrame, connections: DataFrame) -> DataFrame:
    """Node expansion: an edge runs between nodes of its own; connections join them at weight 0.

    ``edges`` has id, from, to, weight; ``connections`` from and to edges, lanes ignored.
    """
    own = edges.select("id", F.concat("from", F.lit('"'), "id").alias("tail"), F.concat("to", F.lit('"'), "id").alias("head"), "weight")
    links = connections.select("from", "to").distinct()
    a = edges.select(F.col("id").alias("from"), F.concat("to", F.lit('"'), "id").alias("tail"))
    b = edges.select(F.col("id").alias("to"), F.concat("from", F.lit('"'), "id").alias("head"))
    joined = links.join(a, "from").join(b, "to")
    return own.unionByName(joined.select(roads.connection_id(F.col("from"), F.col("to")).alias("id"), "tail", "head", F.lit(0).cast("bigint").alias("weight")))


def complete_connections(edges: DataFrame) -> DataFrame:
    """Every edge into a node with every edge out of it."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("head").alias("node"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("tail").alias("node"))
    return a.join(b, "node").select("node", "from_edge", "to_edge")


def connection_counts(edges: DataFrame, connections: DataFrame) -> DataFrame:
    """By node: possible and actual connections, and u-turns among either."""
    e = edges.select("edge_id", "tail", "head")
    f, t = e.alias("f"), e.alias("t")
    turn = (F.col("f.tail") == F.col("t.head")).cast("int")
    possible = f.join(t, F.col("f.head") == F.col("t.tail")).groupBy(F.col("f.head").alias("node")).agg(F.count(F.lit(1)).alias("possible"), F.sum(turn).alias("possible_u"))
    actual = connections.join(f, F.col("from_edge") == F.col("f.edge_id")).join(t, F.col("to_edge") == F.col("t.edge_id"))
    actual = actual.groupBy(F.col("f.head").alias("node")).agg(F.count(F.lit(1)).alias("actual"), F.sum(turn).alias("actual_u"))
    zero = F.lit(0).cast("bigint")
    return possible.join(actual, "node", "left").select("node", "possible", "possible_u", F.coalesce("actual", zero).alias("actual"), F.coalesce("actual_u", zero).alias("actual_u"))


def directed_links(links: DataFrame) -> DataFrame:
    """Two-way links (direction B) to two edges, F along and T against the reference node."""
    ways = F.when(F.col("direction") == "B", F.array(F.lit("F"), F.lit("T"))).otherwise(F.array("direction"))
    d = links.withColumn("way", F.explode(ways))
    along = F.col("way") == "F"
    return d.withColumns({"tail": F.when(along, F.col("ref_node")).otherwise(F.col("nonref_node")), "head": F.when(along, F.col("nonref_node")).otherwise(F.col("ref_node"))})


def link_lengths(geometry: DataFrame) -> DataFrame:
    """Metres along the points (seq, lat, lon) of each link."""
    w = Window.partitionBy("link_id").orderBy("seq")
    d = roads.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return geometry.select("link_id", d.alias("d")).groupBy("link_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"))


def varying_profiles(profiles: DataFrame, first: int, last: int) -> DataFrame:
    """Profiles (tail, head, speeds, position) that vary, sliced; of equal pairs the last wins."""
    v = profiles.where(F.size(F.array_distinct("speeds")) > 1)
    sliced = F.slice("speeds", first + 1, last - first)
    return v.groupBy("tail", "head").agg(F.max_by(sliced, "position").alias("speeds"))


def valid_trips(trips: DataFrame, edges: DataFrame, begin: float, end: float) -> DataFrame:
    """Trips whose both edges are known and that depart in [begin, end)."""
    known = edges.select("edge_id")
    ok = trips.where((F.col("depart") >= begin) & (F.col("depart") < end))
    return ok.join(known, ok["from_edge"] == known["edge_id"], "left_semi").join(known.alias("k"), F.col("to_edge") == F.col("k.edge_id"), "left_semi")


def scaled(edges: DataFrame, factor: float, share: float, seed: int) -> DataFrame:
    """Weights of a share of the edges, chosen by a hash of the id and a seed, times a factor."""
    chosen = chance.uniform("edge_id", seed) < share
    return edges.withColumn("weight", F.when(chosen, (F.col("weight") * factor).cast("bigint")).otherwise(F.col("weight")))


def with_live(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges with a live weight (edge_id, live) where there is one."""
    return edges.join(live, "edge_id", "left").withColumn("weight", F.coalesce("live", "weight")).drop("live")


def expand_csr(nodes: DataFrame) -> DataFrame:
    """Edges of compressed rows: nodes with first_out and the list ``heads`` of what follows."""
    return nodes.select(F.col("node_id").alias("tail"), F.posexplode("heads").alias("k", "head")).select((F.col("k")).alias("k"), "tail", "head")
