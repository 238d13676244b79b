"""Parquet tables in the order in which their rows are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.plans.staging import stage


def read_stored_order(
    spark: SparkSession, path: str | Sequence[str], row_index: str = "row_index"
) -> DataFrame:
    """The table with ``row_index``, the 0-based position over all files in path order.

    The scan knows a row's position in its file, and the file footers know how many
    rows come before; so positions cost neither a shuffle nor a sort, and row queries
    and systematic samples on them are plain filters.
    """
    paths = [path] if isinstance(path, str) else list(path)
    table = spark.read.parquet(*paths)
    if row_index in table.columns:
        raise ValueError(f"the table has a column {row_index!r}: choose another row_index")
    files = table.select(F.col("_metadata.file_path").alias("__rt_file"))
    starts = files.groupBy("__rt_file").agg(F.count(F.lit(1)).alias("__rt_n")).selectExpr(
        "__rt_file",
        "sum(__rt_n) over (order by __rt_file) - __rt_n as __rt_start",  # one row per file
    )
    starts = stage(starts, "files")  # written, its size is known: the planner broadcasts it while it is small
    placed = table.select(
        "*", F.col("_metadata.file_path").alias("__rt_at"), F.col("_metadata.row_index").alias("__rt_row")
    )
    joined = placed.join(starts, F.col("__rt_at") == F.col("__rt_file"))
    index = (F.col("__rt_start") + F.col("__rt_row")).alias(row_index)
    return joined.select(index, *table.columns)
