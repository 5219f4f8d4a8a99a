"""Aggregates of experiments: gaps, phases, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import ttf
from routeloom.operators import network


def ordered_lookup(items: DataFrame, names: DataFrame, key: str, pos: str, name: str, value: str) -> DataFrame:
    """Lists of names to lists of ids in their order, joined by spaces as ``path``."""
    j = items.join(names, name)
    ids = F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda x: x[value].cast("string"))
    return j.groupBy(key).agg(F.array_join(ids, " ").alias("path"))


def delay_stats(functions: DataFrame) -> DataFrame:
    """Relative delays (max - min) / min of functions ``f``: mean, mean of varying ones, total,
    and the middle element of the varying ones by thousandths.

    The median is found by place, not by collecting: rows are ranked and the one at n/2 kept.
    """
    lo, hi = ttf.lower_bound(F.col("f")), ttf.upper_bound(F.col("f"))
    e = functions.select("edge_id", ((hi - lo) / lo).alias("d"), (F.size("f") > 1).alias("varies"))
    stats = e.agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.avg(F.when(F.col("varies"), F.col("d"))), 6).alias("mean_varying"), F.round(F.sum("d"), 6).alias("total"), F.count_if("varies").alias("n"))
    ranked = e.where("varies").withColumn("k", F.row_number().over(Window.orderBy(F.floor(F.col("d") * 1000), "edge_id")) - 1)
    middle = ranked.join(F.broadcast(stats.select("n")), F.col("k") == F.floor(F.col("n") / 2)).select(F.round("d", 6).alias("median"))
    return stats.drop("n").crossJoin(F.broadcast(middle))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, interpolated; a column for each name in ``shares``.

    Distinct values are counted and numbered by ranges, so that no task holds those of a group.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = network.running_sum(counts.withColumn("_o", F.struct(*names, "_v")), "_o", "_c", "_before")
    whole = upto.groupBy(*names).agg(F.min("_before").alias("_first"), F.sum("_c").alias("_all")).toDF(*[f"_g{i}" for i in range(len(by))], "_first", "_all")
    same = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(f"_g{i}")) for i in range(len(by))], F.lit(True))
    each = upto.join(whole, same) if by else upto.crossJoin(F.broadcast(whole))
    start = F.col("_before") - F.col("_first")
    holds = lambda place: (place >= start) & (place < start + F.col("_c"))
    found, out = [], []
    for k, (name, p) in enumerate(shares.items()):
        place = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        found += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l{k}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_h{k}"), F.max(place).alias(f"_p{k}")]
        at = F.col(f"_p{k}")
        between = (F.ceil(at) - at) * F.col(f"_l{k}") + (at - F.floor(at)) * F.col(f"_h{k}")
        out.append(F.when(F.floor(at) == F.ceil(at), F.col(f"_l{k}")).when(F.col(f"_l{k}") == F.col(f"_h{k}"), F.col(f"_l{k}")).otherwise(between).alias(name))
    return each.groupBy(*names).agg(*found).select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], *out)


def _beside(groups: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``groups`` with what was found for each; null where nothing was."""
    f = found.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    return groups.join(f, same, "left").drop(*[f"_{c}" for c in by])


def iteration_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    groups = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.min("value"), 4).alias("lo"),
        F.round(F.stddev_pop("value"), 3).alias("std"),
    )
    return _beside(groups, percentiles(runs, by, "value", {"median": 0.5}), by).select(*by, "n", "mean", F.round("median", 4).alias("median"), "lo", "std")


def pairwise(values: DataFrame, group: str, on: str, value: str) -> DataFrame:
    """Differences of each two groups over their common ``on``: mean, median, MAD, RMSE."""
    a, b = values.alias("a"), values.alias("b")
    d = a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & (F.col(f"a.{group}") < F.col(f"b.{group}")))
    d = d.select(F.col(f"a.{group}").alias("a"), F.col(f"b.{group}").alias("b"), (F.col(f"a.{value}") - F.col(f"b.{value}")).alias("d"))
    groups = d.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("d"), 3).alias("mean_diff"),
        F.round(F.avg(F.abs("d")), 3).alias("mad"),
        F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 3).alias("rmse"),
    )
    found = _beside(groups, percentiles(d, ["a", "b"], "d", {"median": 0.5}), ["a", "b"])
    return found.select("a", "b", "n", "mean_diff", F.round("median", 3).alias("median_diff"), "mad", "rmse")


def best_runs(runs: DataFrame, by: list[str], run: str, value: str) -> DataFrame:
    """Of each group the run with the least value, the smallest of equals."""
    return runs.groupBy(*by).agg(F.min_by(run, F.struct(value, run)).alias(run), F.min(value).alias(value))


def describe(rows: DataFrame, value: str) -> DataFrame:
    whole = rows.agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.stddev_samp(value), 3).alias("std"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    quarters = percentiles(rows, [], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return whole.crossJoin(F.broadcast(quarters)).select("n", "mean", "std", "lo", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "hi")


def r_squared(rows: DataFrame, key: str, seen: str, fitted: str) -> DataFrame:
    """1 - sum of squares / (n * variance); 0 where there is no variance."""
    r = 1 - F.sum(F.pow(F.col(seen) - F.col(fitted), F.lit(2))) / (F.count(F.lit(1)) * F.var_pop(seen))
    return rows.groupBy(key).agg(F.round(F.when(F.var_pop(seen) > 0, r).otherwise(0.0), 6).alias("r2"))


def convergence(steps: DataFrame, key: str, step: str, value: str, last: int) -> DataFrame:
    """Each step's mean and the relative deviation over the last steps."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(1 - last, 0)
    return steps.select(key, step, F.round(value, 4).alias("mean"), F.round(F.stddev_pop(value).over(w) / F.avg(value).over(w), 6).alias("rel_std"))
