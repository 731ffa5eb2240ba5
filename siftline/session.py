"""Small session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

_scope: ContextVar[list[str] | None] = ContextVar("siftline_scope", default=None)  # each thread has its own
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package from where the driver found it.

    On a cluster the package is installed or sent with ``--py-files``; this only adds the
    driver's own location to the workers' search path, which is what local mode needs.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local master
    gets a fresh folder of this machine; on a cluster, whose executors don't share one, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind (of Spark 4.1 on): else they stay until the driver happens to
    collect its garbage, and the disk holds those of all steps. A later read would make them again."""
    before = spark.conf.get(FREED, None)
    if not spark.conf.isModifiable(FREED):
        yield
        return
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a short lineage that survives
    the loss of any executor, and a result that is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(path)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side that joins never broadcast: for tables that grow with the input, whose size as Spark
    guesses it (of files, or of the scan that arrays and structs were made from) says little of their rows in memory."""
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what :func:`cut` has written inside: for callers that write their result
    before they leave. Without it the tables stay until the shared folder is cleared."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            delete(spark, path)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores in front as it takes to be none of ``columns`` in any case of letters."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` with a number for each row, written, so that all later scans agree on it, and its column's name."""
    row = free_name(df.columns, "row_number")
    return cut(df.withColumn(row, F.monotonically_increasing_id()), name), row


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has: a small file is one task's, however much is made of its rows.
    By ``keys``, if any. Deal the columns that the rest is made of, so that little moves."""
    return df.repartition(partitions(df.sparkSession), *keys)


ROWS = 8192  # of a table that one task makes many rows of each
GROUPED = 32  # times as many, where a row is only hashed or looked up


def tasks_for(df: DataFrame, times: int = 1) -> int:
    """How many tasks have ``times`` ROWS rows of ``df`` each, at least one for each core. Counts them, so ``df`` should
    be a table. For ``repartition``: how many partitions a grouping gets is else guessed from compressed bytes."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (times * ROWS)))
