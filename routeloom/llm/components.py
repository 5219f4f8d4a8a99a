"""Connected components of an edge list, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns ``node`` and ``label``, the smallest node reachable, for all nodes of ``edges``.

    Every round takes the smallest label among the neighbours, then the label's own label
    (pointer jumping), so that long chains shrink geometrically. Each round is a written
    table; only the count of changed labels reaches the driver. Joins are on one key each,
    next to their exchanges, so that the adaptive planner can split hubs. Null ends are
    no edges; self-loops and repeated edges are harmless; an empty list gives no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = written(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")),
            "step",
        )
        roots = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = written(step.join(roots, "label").select("node", "old", F.col("root").alias("label")), "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
