"""Bounded samples of labelled documents, and folds by crc32 of the id."""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import text_or_empty


def fold(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % modulus


def fold_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def bounded(rows: DataFrame, limit: int, seed: str) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of doc_id.

    Of many rows, a share that holds about twice the limit is taken by the hash first: each
    task would else send its own ``limit`` smallest to the driver.
    """
    n = rows.count()
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    few = rows.where(u < 2 * limit / n) if n > 2 * limit else rows
    return few.orderBy(u, "doc_id").limit(limit)


def sample_ids(labels: DataFrame, label: str, learn: Column, per_class: int) -> list[tuple[int, int]]:
    """At most ``per_class`` (doc_id, label) of each class, in the order of a hash of the id.

    Rows without id or label are left out; where labels differ for an id the larger counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    out = []
    for y in (0, 1):
        out += [(r["doc_id"], y) for r in bounded(rows.where(F.col("y") == y), per_class, "labels").collect()]
    return out


def texts_of(docs: DataFrame, ids: list[tuple[int, int]], chars: int) -> list[tuple[str, int]]:
    """Whole texts of the sample and their labels, so many characters of each label at most.

    Of rows with one id that with the smallest text counts. Lengths are asked first, and texts
    taken in the order of ``ids`` until they hold ``chars``; one beyond that is left out, whole.
    """
    spark = docs.sparkSession
    if not ids:
        return []
    one = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(ids, "s_id bigint, s_y int")), F.col("doc_id") == F.col("s_id"))
    length = F.length(text_or_empty())
    sizes = {r["doc_id"]: r["n"] for r in one.groupBy("doc_id").agg(F.min(length).alias("n")).collect()}
    left, taken = Counter({0: chars, 1: chars}), []
    for i, y in ids:
        if i in sizes and sizes[i] <= left[y]:
            left[y] -= sizes[i]
            taken.append((i, y, sizes[i]))
    if not taken:
        return []
    want = F.broadcast(spark.createDataFrame(taken, "s_id bigint, s_y int, s_n int"))
    rows = docs.select("doc_id", "text").join(want, (F.col("doc_id") == F.col("s_id")) & (length == F.col("s_n")))
    found = rows.groupBy("doc_id", "s_y").agg(F.min(text_or_empty()).alias("text")).collect()
    return [(r["text"], r["s_y"]) for r in sorted(found, key=lambda r: r["doc_id"])]
