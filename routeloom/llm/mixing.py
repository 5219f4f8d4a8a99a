"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm.common import NOT_WS, table, text_key, text_or_empty, written

MAX_REPEAT = 3
SEED = 20240
#: Documents of one flight at a time; leftovers of all flights fly again together.
BLOCK = 5000
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, th, source and size: the text's words, counted without splitting it."""
    # The text with each word replaced by one letter and all white space gone.
    words = F.length(F.regexp_replace(F.regexp_replace(text_or_empty(), NOT_WS + "+", "w"), r"[\x20\x09-\x0D]+", ""))
    return docs.select("doc_id", text_key().alias("th"), "source", words.cast("bigint").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target, one row per source.

    A source's share is its weight times a level; shares stop at MAX_REPEAT times the
    source's size. Ordered by that cap over the weight, the capped sources come first, so
    the level follows from running sums: it is that of the first source which its own level
    leaves under its cap. This is where resharing the excess by weight ends.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("weight", (F.row_number().over(everything) - 1) % 3 + 1).withColumn("cap", F.lit(MAX_REPEAT) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    open_ = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    final = open_.withColumn("level", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("c"), F.col("level").alias("level")))).over(whole)["level"])
    share = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return final.select("source", F.col("source_size").cast("bigint").alias("source_size"), share.alias("target"))


def _direction(active: list[list]) -> list[float]:
    """A vector in the null-space of the constraints, size and count, of two or three units."""
    if len(active) == 2:
        return [1.0, -1.0]
    a, b, c = (x[1] for x in active)
    u = [float(b - c), float(c - a), float(a - b)]
    return u if any(u) else [1.0, -1.0, 0.0]


def fly(units: Iterator[tuple], random: np.random.Generator) -> Iterator[tuple]:
    """The flight phase of the cube method over (key, size, probability), as a stream.

    Three units are held. Their probabilities move along the null-space of the balancing
    constraints - the sum of probabilities, and of sizes times probabilities - until one
    reaches 0 or 1 and leaves; the two ways are drawn so that each unit's expectation stays.
    Yields (key, size, probability): 0 or 1, but for the two or fewer that are left at the
    end. Memory is constant, time linear.
    """
    active: list[list] = []
    for key, size, p in units:
        if p <= EPS or p >= 1 - EPS:
            yield key, size, float(round(p))
            continue
        active.append([key, size, p])
        while len(active) == 3 or (len(active) == 2 and active[0][1] == active[1][1]):
            u = _direction(active)
            up = min((1 - x[2]) / d if d > 0 else x[2] / -d for x, d in zip(active, u, strict=True) if d)
            down = min(x[2] / d if d > 0 else (1 - x[2]) / -d for x, d in zip(active, u, strict=True) if d)
            step = up if random.random() * (up + down) < down else -down
            for x, d in zip(active, u, strict=True):
                x[2] += step * d
            still = []
            for x in active:
                if x[2] <= EPS or x[2] >= 1 - EPS:
                    yield x[0], x[1], float(round(x[2]))
                else:
                    still.append(x)
            if len(still) == len(active):  # rounding kept it from the edge: the nearest leaves
                x = min(still, key=lambda x: min(x[2], 1 - x[2]))
                still.remove(x)
                yield x[0], x[1], float(round(x[2]))
            active = still
    for key, size, p in active:
        yield key, size, p


def land(left: list[tuple]) -> list[tuple]:
    """The landing of at most two units: the choice whose sizes come nearest to their expectation."""
    want = sum(s * p for _, s, p in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(s for k, (_, s, _) in enumerate(left) if m >> k & 1) - want), m))
    return [(key, s, float(best >> k & 1)) for k, (key, s, _) in enumerate(left)]


def _flight(final: bool):
    """Flies each run of rows with one ``block``; ``final`` lands what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "ordinal", "source", "size", "p"]

        def rows():
            for b in batches:
                yield from zip(*(b.column(n).to_pylist() for n in ["block", *names]), strict=True)

        def flights():
            current, held = None, None
            for block, *row in rows():
                if held is None or block != current:
                    if held is not None:
                        yield current, held
                    current, held = block, []
                held.append((tuple(row[:4]), row[4], row[5]))
            if held is not None:
                yield current, held

        out: list[tuple] = []
        for block, units in flights():
            seed = int.from_bytes(hashlib.sha256(f"{SEED}:{block}".encode()).digest()[:8], "big")
            done = list(fly(iter(units), np.random.default_rng(seed)))
            if final:
                left = [x for x in done if 0 < x[2] < 1]
                done = [x for x in done if not 0 < x[2] < 1] + land(left)
            out += [(*key, size, p) for key, size, p in done]
            if len(out) > 20_000:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


UNIT = "doc_id bigint, th bigint, ordinal bigint, source string, size bigint, p double"


def balance(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Units (UNIT, p a probability) with p moved to 0 or 1, balanced within each source.

    A source is dealt by hash to blocks of about ``block`` units. Every flight leaves at most
    two units open; those of all blocks fly again, until a source has one block, which lands.
    A level leaves at most two in ``block`` units, so a few levels serve any size. Raises where
    a level leaves as many open as there were (a ``block`` of one or two), so that none is lost.
    """
    spark = units.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    closed: list[DataFrame] = []
    open_ = units
    level, before = 0, None
    while True:
        counts = written(open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
        largest, left = counts.agg(F.max("n"), F.sum("n")).first()
        final = (largest or 0) <= block
        if before is not None and not final and left >= before:
            raise ValueError(f"blocks of {block} units don't shrink what is open")
        before = left
        dealt = open_.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, open_["source"].eqNullSafe(counts["source"])).select(
            *[open_[c] for c in open_.columns],
            F.concat_ws(
                ":",
                F.lit(str(level)),
                F.coalesce(F.hex(open_["source"]), F.lit("null")),
                F.pmod(F.xxhash64("doc_id", "th", "ordinal", F.lit(level)), F.ceil(F.col("n") / block)),
            ).alias("block"),
        )
        ordered = dealt.repartition(n, "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_last(), "th", "ordinal")
        flown = written(ordered.mapInArrow(_flight(final), UNIT), "mix-flown")
        closed.append(flown.where("p = 0 OR p = 1"))
        if final:
            break
        open_ = flown.where("p > 0 AND p < 1")
        level += 1
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, th, source, size, source_size, target, copies and taken (copies times size).

    A source's documents are wanted target / source_size times. The whole part is taken of
    each document; the rest is a probability, drawn by the cube method so that words and
    documents come near their totals. The same rows give the same draw, however they are
    partitioned. Uses doc_id, text and source; other columns are ignored. A null text has
    size 0, a null source is a source of its own, the last. Rows repeated with one id and
    text are numbered and drawn one by one. A source without words is taken 0 times; an
    empty table gives no rows.
    """
    sized = written(sizes(docs), "mix-sizes")
    goal = written(targets(sized), "mix-targets")
    # One number for rows alike in id, text and source, so that each is drawn by itself.
    grouped = sized.groupBy("doc_id", "th", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal_t = goal.select(F.col("source").alias("t_source"), "source_size", "target")
    small = F.broadcast(goal_t) if goal.count() <= 10_000 else goal_t
    rated = grouped.join(small, grouped["source"].eqNullSafe(F.col("t_source"))).drop("t_source")
    rated = rated.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rated.withColumn("base", F.floor(F.col("ratio") + EPS))
    rated = written(rated.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ordinal")), "mix-rated")
    units = rated.select("doc_id", "th", F.col("ordinal").cast("bigint").alias("ordinal"), "source", "size", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio") - F.col("base"))).alias("p"))
    drawn = balance(units, block).select("doc_id", "th", "ordinal", "source", "size", F.col("p").cast("bigint").alias("extra"))
    rates = goal_t.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    small = F.broadcast(rates) if goal.count() <= 10_000 else rates
    out = drawn.join(small, drawn["source"].eqNullSafe(F.col("t_source")))
    copies = F.floor(F.col("ratio") + EPS) + F.col("extra")
    return out.select("doc_id", "th", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op8_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; see ``mix``.

    Rows travel as structs, so that no name of a column can clash. Rows alike in id, text and source
    share their copies, the first ones by all columns taking the rest. An empty table gives no rows.
    """
    drawn = mix(docs)
    times = drawn.groupBy("doc_id", "th", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_key().alias("h"), F.col("source").alias("of"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")) & F.col("of").eqNullSafe(F.col("source"))
    found = rows.join(times, same)
    single = found.where("n = 1").select("row", "copies")
    own = Window.partitionBy("id", "h", "of").orderBy("row")
    several = found.where("n > 1").withColumn("k", F.row_number().over(own))
    several = several.select("row", (F.floor((F.col("copies") - F.col("k")) / F.col("n")) + 1).alias("copies")).where("copies > 0")
    return single.unionByName(several).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
