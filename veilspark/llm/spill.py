"""Cutting lineage through the shared folder that the cluster names in spark.checkpoint.dir.

Two kinds of intermediate rows: what the returned DataFrame still reads is checkpointed
(``materialise``; Spark deletes it once nothing refers to it, if
spark.cleaner.referenceTracking.cleanCheckpoints is set), and what only later steps of the same
operator read is a table of a ``Scratch``, dropped as soon as its successor is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in one process, as in local tests.
LOCAL_FOLDER = "/tmp/checkpoints/veilspark"

#: Bytes of an Arrow batch sent to Python; the JVM and the worker both hold a few.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Deletes the shuffle files of a query when it ends; the queries here read theirs once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Makes sure of a shared folder; on a cluster that names none it raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_FOLDER
    sc.setCheckpointDir(folder)


@contextmanager
def settings(spark: SparkSession, **pairs: str) -> Iterator[None]:
    """The session with these settings, and with its own again afterwards."""
    was = {k: spark.conf.get(k, None) for k in pairs}
    try:
        for k, v in pairs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_BYTES, whatever the length of its rows.

    The setting stays: the plan that the caller gets runs later and needs it too.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).lower().rstrip("b")  # bytes, as Spark prints the default, or with a unit
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there ever after."""
    spark = df.sparkSession
    prepare(spark)
    with settings(spark, **{_CLEANUP: "true"}):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder for the steps of one operator; leaving it, or Spark's end, drops those left."""

    def __init__(self, spark: SparkSession) -> None:
        prepare(spark)
        self.spark = spark
        self._top = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self._top).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._path(self._top))  # should the driver end first
        self._tables: dict[str, DataFrame] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._files.delete(self._path(self._top), True)
        self._tables.clear()

    def table(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """``df`` as a Parquet table; the tables ``done``, which nothing else needs, are dropped."""
        path = f"{self._top}/{len(self._tables)}-{uuid.uuid4().hex[:8]}"
        with settings(self.spark, **{_CLEANUP: "true"}):
            df.write.parquet(path)
        self.drop(*done)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables[path] = out
        return out

    def folder(self, name: str) -> str:
        """A path in the shared folder for files that a step writes itself."""
        return f"{self._top}/{name}-{uuid.uuid4().hex[:8]}"

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self._tables.items() if any(t is x for x in tables)]:
            self._files.delete(self._path(path), True)
            del self._tables[path]
