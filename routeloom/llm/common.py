"""Helpers shared by the corpus operators: written tables, row keys, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator: space and \t \n \v \f \r.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, and only by a local master, where
    driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _own_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables written by this process, in order.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs a read of the table, not its computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables ``written`` has made so far; where ``drop_written`` may begin."""
    return len(_made)


def drop_written(spark: SparkSession, since: int) -> None:
    """Deletes the tables that ``written`` made after the first ``since``, but for the last one; for a
    job that needs only that one from now on."""
    old = _made[since:-1]
    for path in old:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del _made[since:-1]


def release(spark: SparkSession) -> None:
    """Collects garbage on the driver, so that Spark's cleaner deletes shuffles and broadcasts that
    nothing refers to any more; for jobs of many small rounds."""
    spark.sparkContext._jvm.System.gc()


#: Numbers in a written table up to which it is broadcast.
SMALL = 4_000_000


def if_small(df: DataFrame, extra: Column | None = None) -> DataFrame:
    """``df``, a written table of a few numbers a row (``extra`` gives more of them), marked for
    broadcast if the sum allows it; a larger one is joined by a shuffle."""
    size = df.agg(F.sum(F.lit(len(df.columns)) + (F.lit(0) if extra is None else extra))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keeps Arrow batches of whole texts small, as some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """A hash of the text; beside doc_id it identifies a row where ids are null or repeated."""
    return F.xxhash64(text_or_empty(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once.

    The optimizer inlines a column that is used once into a lambda, where it would be
    computed again for each element. A lambda's variable is not inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
