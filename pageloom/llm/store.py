"""Where the operators keep tables between their stages.

A stage that several later ones read, or whose lineage would grow, is written as Parquet
under spark.checkpoint.dir, which a cluster shares between driver and executors: lost
executors then cost the running tasks only.  Where the session names no folder, one is made on
this machine if driver and executors are one process there (tests); elsewhere that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get().rstrip("/")


#: With it, Spark removes the shuffle files of an execution at its end (the written table stands in for them).
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


#: Folders of this process that are still there, oldest first.
_made: list[Workspace] = []


class Workspace:
    """Tables of one call of an operator.

    An operator's result is read when it is used, and may read them until then; so they go when the caller says so (``scratch``,
    ``release``), or at the latest when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def remove(self) -> None:
        self.drop("")
        if self in _made:
            _made.remove(self)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df, written (in a folder for each value of ``by``) and read again; the shuffle files of its plan go."""
        at = f"{self.path}/{name}"
        with cleaned(self.spark):
            out = df.write.option("compression", "zstd")
            (out.partitionBy(by) if by else out).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch():
    """What operators keep inside goes at the end; by then their results must be written or collected."""
    before = list(_made)
    try:
        yield
    finally:
        for w in [w for w in _made if w not in before]:
            w.remove()


def release() -> None:
    """All tables that operators of this process have kept go; no result that isn't written yet can be read after it."""
    for w in list(_made):
        w.remove()


@atexit.register
def _at_end() -> None:
    if _made and SparkContext._gateway is not None and SparkContext._active_spark_context is not None:
        release()


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, whatever else the input carries."""
    return df.select(*[df[c] for c in columns])
