"""Cut lineage with tables written to storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corvane.errors import ConfigurationError

_LOCAL: dict[str, str] = {}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A checkpoint folder set on the context counts as well. Only a session whose
    master is local, so that driver and executors are one machine, may do
    without: it gets a temporary folder, once per application.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new unused path in the shared folder; removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return a scan of it.

    The files outlive any executor, hold each column apart (later steps read
    only what they need) and give the planner true sizes.
    """
    return materialize_all([df], name)


def materialize_all(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write tables of the same columns, one after another, as one; ``parts`` isn't empty and may be made as it goes."""
    path = ""
    for df in parts:
        path = path or scratch_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["_corvane_path"] = path
    return table


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside delete their shuffle files as they end, not when the driver happens to collect its garbage.

    What is run inside must not be run a second time from the same DataFrame: that would shuffle again.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def discard(table: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that no later step reads; another table is left alone."""
    path = table.__dict__.pop("_corvane_path", None)
    if path is not None:
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
