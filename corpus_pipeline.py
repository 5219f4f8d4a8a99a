"""Documents to packed sequences, in five stages over the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routeloom.llm import common, linededup, mixing, packing, simhash, toxicity

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("line_dedup", linededup.dedup_stage),
    ("simhash_near_dedup", simhash.dedup_stage),
    ("source_mixing", mixing.mix_stage),
    ("best_fit_packing", packing.pack_stage),
]

#: Tagging by a trained field and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each reads its predecessor's table. What a stage
    has written on its way is deleted once its output is."""
    docs, begun = common.table(spark, sf_dir, "documents"), common.tables_written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
            common.drop_written(spark, begun)
    return docs
