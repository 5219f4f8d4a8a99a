"""Measurements by interval and edge, feeds, and their functions of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(edges: DataFrame, intervals: DataFrame, measured: DataFrame, value: str, default: str) -> DataFrame:
    """Every edge in every interval: the measured value, or the edge's default.

    The number of intervals is a day's worth, so they are sent to the edges; the product is
    the result itself, one row per edge and interval.
    """
    grid = edges.crossJoin(F.broadcast(intervals))
    return grid.join(measured, ["edge_id", "begin_s"], "left").withColumn(value, F.coalesce(value, default))


def fifo(rows: DataFrame, key: str = "edge_id", at: str = "at", val: str = "val") -> DataFrame:
    """Values cut so that nobody overtakes: the least arrival from a point on, less its time."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(val, F.min(F.col(at) + F.col(val)).over(w) - F.col(at))


def run_starts(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows where the value differs from the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_before", F.lag(value).over(w)).where(~F.col("_before").eqNullSafe(F.col(value)) | F.col("_before").isNull()).drop("_before")


def weighted_speeds(samples: DataFrame, bucket_len: int, least: int = 3) -> DataFrame:
    """Mean speed by edge and bucket (edge_id, t, speed), weighted by the time around a sample.

    A sample weighs the span from the one before to the one after; the first counts from the
    bucket's start to the second, the last from the one before to the bucket's end. Buckets
    of fewer than ``least`` samples have no row.
    """
    s = samples.withColumn("bucket", F.floor(F.col("t") / bucket_len))
    w = Window.partitionBy("edge_id", "bucket").orderBy("t", "sample_id")
    before = F.coalesce(F.lag("t").over(w), F.col("bucket") * bucket_len)
    after = F.coalesce(F.lead("t").over(w), (F.col("bucket") + 1) * bucket_len)
    weighed = s.withColumn("weight", after - before)
    g = weighed.groupBy("edge_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight") * F.col("speed")).alias("ws"), F.sum("weight").alias("w"))
    return g.where((F.col("n") >= least) & (F.col("w") > 0)).select("edge_id", "bucket", "n", (F.col("ws") / F.col("w")).alias("speed"))


def import_counts(rows: DataFrame) -> DataFrame:
    """How many samples apply, and why the others don't: edge unknown, too fast, out of range,
    in this order (columns known, speed, in_range; 1000 km/h stands for an unread speed)."""
    unknown, fast = ~F.col("known"), F.col("speed") > 999
    why = F.when(unknown, "no_edge").when(fast, "too_fast").when(~F.col("in_range"), "out_of_range").otherwise("applied")
    return rows.select(why.alias("why")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("why") == k).alias(k) for k in ("applied", "no_edge", "too_fast", "out_of_range")])


def point_in_interval(points: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Points (t) with the interval [begin_s, begin_s + width) they lie in: an equi-join on the
    interval's number instead of a comparison of all."""
    p = points.withColumn("begin_s", F.floor(F.col("t") / width) * width)
    return p.join(intervals, "begin_s")


def overlaps(spans: DataFrame, width: int) -> DataFrame:
    """Spans [enter, exit) dealt to intervals of a width, with the seconds in each."""
    first, last = F.floor(F.col("enter") / width).cast("bigint"), F.floor((F.col("exit") - 1e-9) / width).cast("bigint")
    s = spans.where("exit > enter").withColumn("k", F.explode(F.sequence(first, F.greatest(first, last))))
    seconds = F.least("exit", (F.col("k") + 1) * width) - F.greatest("enter", F.col("k") * width)
    return s.withColumns({"begin_s": F.col("k") * width, "seconds": seconds}).drop("k")


def as_of(points: DataFrame, series: DataFrame, key: str, width: int) -> DataFrame:
    """The last value of ``series`` (key, at, val) at or before each point's ``t``.

    One union and one window by key and bucket of ``width``: a scan carries the last value forward,
    where a join on an inequality would compare all pairs, and a hot key is many groups. Each
    bucket begins with the last value before it, carried over the buckets' own last ones.
    """
    k = F.floor(F.col("t") / width).alias("_k")
    a = series.select(key, F.col("at").alias("t"), F.struct("at", "val").alias("_v"), F.lit(0).alias("_o"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c not in (key, "t")])
    b = points.select(key, "t", F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_o"), *[c for c in points.columns if c not in (key, "t")])
    rows = a.unionByName(b).withColumn("_k", k)
    each = rows.groupBy(key, "_k").agg(F.max("_v").alias("_end"))
    before = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(key, "_k", F.last("_end", ignorenulls=True).over(before).alias("_v")).where("_v IS NOT NULL")
    w = Window.partitionBy(key, "_k").orderBy(F.col("t").asc_nulls_first(), "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = rows.unionByName(carried.withColumn("_o", F.lit(0)), allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_o = 1")
    return u.select(*points.columns, F.col("_last.at").alias("at"), F.col("_last.val").alias("val"))


def moving_average7(values):
    """Circular mean over three neighbours on each side, whole numbers rounded down."""
    from routeloom.functions.ttf import let

    around = F.sequence(F.lit(-3), F.lit(3))
    return let(values, lambda a: F.transform(a, lambda x, i: F.call_function("div", F.aggregate(around, F.lit(0).cast("bigint"), lambda s, d: s + a[F.pmod(i + d, F.size(a)).cast("int")]), F.lit(7))))


def off_peak(values, night_from: int, morning: int, floor: int = 5):
    """Night buckets (from ``night_from`` on and the first ``morning``) take the day's largest
    speed; nothing is below ``floor``."""
    from routeloom.functions.ttf import let

    return let(F.array_max(values), lambda m: F.transform(values, lambda x, i: F.greatest(F.when((i >= night_from) | (i < morning), m).otherwise(x), F.lit(floor).cast("bigint"))))


def gaps(intervals: DataFrame, key: str) -> DataFrame:
    """What lies between a key's intervals [begin, end): the complement within their hull."""
    w = Window.partitionBy(key).orderBy("begin", "end")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("from", so_far).where(F.col("begin") > F.col("from")).select(key, "from", F.col("begin").alias("to"))


def uncovered_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges [begin, end] that contain no other range of their key (the minimal ones)."""
    w = Window.partitionBy(key).orderBy(F.col("begin").desc(), F.col("end")).rowsBetween(Window.unboundedPreceding, -1)
    d = ranges.dropDuplicates([key, "begin", "end"])
    return d.withColumn("_inner", F.min("end").over(w)).where(F.col("_inner").isNull() | (F.col("end") < F.col("_inner"))).drop("_inner")


def marginal_cost(now: DataFrame, before: DataFrame, exponent: float) -> DataFrame:
    """|d travel time| / |d vehicles| * vehicles^exponent + travel time; the travel time alone
    where the number of vehicles stayed. The earlier travel time is the overlapping one."""
    b = before.select("edge_id", "begin_s", F.col("overlap_tt").alias("b_tt"), F.col("vehicles").alias("b_veh"))
    j = now.join(b, ["edge_id", "begin_s"])
    d = F.col("vehicles") - F.col("b_veh")
    cost = F.abs(F.col("traveltime") - F.col("b_tt")) / F.abs(d) * F.pow(F.col("vehicles"), F.lit(exponent)) + F.col("traveltime")
    return j.withColumn("cost", F.when(d != 0, cost).otherwise(F.col("traveltime"))).drop("b_tt", "b_veh")


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """Counts by bins of a width from the smallest value's whole number on, gaps filled with 0."""
    lo = rows.agg(F.floor(F.min(value)).alias("b0"), F.max(value).alias("b1"))
    bins = lo.where("b0 IS NOT NULL").select("b0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("b1") - F.col("b0")) / width))).alias("bin"))
    n = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(lo)).groupBy(F.floor((F.col(value) - F.col("b0")) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "bin", "left").select("bin", (F.col("b0") + F.col("bin") * width).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))
