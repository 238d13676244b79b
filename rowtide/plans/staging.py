"""Tables written once to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_base: dict[str, str] = {}
#: Whether a query's shuffle files go with its end, not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A temporary folder stands in for it on a local master only; on a cluster a
    machine-local folder would not be seen by the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return qualified(spark, base.rstrip("/"))
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="rowtide-")
    return _local_base[app]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, where one without would not mean a local file to Spark.

    Tasks that open files themselves then find the same file system as Spark does.
    """
    if "://" in path or path.startswith("file:"):
        return path
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    return path if system.getUri().getScheme() == "file" else system.makeQualified(made).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder which no other call gets."""
    return f"{scratch_base(spark)}/rowtide/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; what others have asked for holds again afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts the lineage: what follows survives the loss of executors without running
    ``df`` again, and every later pass sees the same rows. Shuffle files of ``df`` go at
    once, so those of a long row of stages do not add up on disk.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``stage``, after the last use of each; others are left alone."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path is not None:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared folder, on whatever file system it lies."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)
