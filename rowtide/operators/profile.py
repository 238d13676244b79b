"""Counts over imported tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_check(df: DataFrame, counted: Sequence[str] = (), summed: Sequence[str] = ()) -> DataFrame:
    """One row: all rows, non-NULL cells of some columns, sums of others."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"count_{c}") for c in counted],
        *[F.sum(c).alias(f"sum_{c}") for c in summed],
    )


def frame_count(df: DataFrame, file_column: str = "file_path") -> DataFrame:
    """Rows per file."""
    return df.groupBy(file_column).agg(F.count(F.lit(1)).alias("frame_count"))


def presence(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, non-NULL cells and their share, all columns in one pass."""
    cols = list(cols or df.columns)
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("n").alias("rows"),
            F.col(f"c{i}").alias("present"),
            F.when(F.col("n") > 0, F.col(f"c{i}") / F.col("n")).alias("presence"),
        )
        for i, c in enumerate(cols)
    ]
    return totals.select(F.inline(F.array(*lines)))
