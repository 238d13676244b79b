"""Rows by value range and by position."""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.typing import parsed
from rowtide.plans.order import BLOCK, offsets, order_rows, with_row_index
from rowtide.plans.staging import stage


def range_query(
    df: DataFrame, field: str, min_value: int | None = None, max_value: int | None = None
) -> DataFrame:
    """Rows whose field, as an integer, lies between the bounds, both inclusive.

    Fractions count towards zero (20.7 as 20). Values without an integer form never
    match, not even without bounds: NULL, NaN, infinities, text that is no integer.
    The filter is on the plain column for numbers, so it reaches the scan.
    """
    return df.where(_in_range(F.col(field), df.schema[field].dataType, min_value, max_value))


def write_sorted(df: DataFrame, path: str, field: str, files: int | None = None) -> None:
    """Write ``df`` as parquet sorted by ``field``, replacing what is at ``path``.

    A range query on the copy skips files and row groups by their minima and maxima.
    Rows of one frequent value are spread over several files.
    """
    spread = df.withColumn("__rt_id", F.monotonically_increasing_id())
    by = [F.col(field), F.col("__rt_id")]
    ranged = spread.repartitionByRange(files, *by) if files else spread.repartitionByRange(*by)
    ranged.drop("__rt_id").sortWithinPartitions(field).write.mode("overwrite").parquet(path)


def _in_range(value: Column, type_: T.DataType, low: int | None, high: int | None) -> Column:
    if isinstance(type_, (T.StringType, T.BooleanType)):
        if isinstance(type_, T.StringType):
            value = parsed(value, "bigint")
        else:
            value = value.cast("bigint")
        type_ = T.LongType()
    if not isinstance(type_, T.NumericType):
        raise TypeError(f"range_query needs a number or text, not {type_.simpleString()}")
    condition = value.isNotNull()
    fractions = isinstance(type_, (T.FractionalType, T.DecimalType))
    floats = isinstance(type_, (T.FloatType, T.DoubleType))
    if floats:
        condition = condition & (value > -math.inf) & (value < math.inf)  # also drops NaN
    if low is not None:
        if fractions and low <= 0:
            condition = condition & (value > _bound(low - 1, floats, up=False))
        else:
            condition = condition & (value >= _bound(low, floats, up=True))
    if high is not None:
        if fractions and high >= 0:
            condition = condition & (value < _bound(high + 1, floats, up=True))
        else:
            condition = condition & (value <= _bound(high, floats, up=False))
    return condition


def _bound(limit: int, floats: bool, up: bool) -> Column:
    """The limit as a literal; for floats the nearest one which changes no result."""
    if not floats:
        return F.lit(limit)
    near = float(limit)
    if up and near < limit:
        near = math.nextafter(near, math.inf)
    elif not up and near > limit:
        near = math.nextafter(near, -math.inf)
    return F.lit(near)


def add_row_index(
    df: DataFrame,
    order_by: Sequence[str] | str | None = None,
    name: str = "row_index",
    unique: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Add the contiguous 0-based position in the given order as the first column."""
    rows = order_rows(df, order_by, (), unique, blocks)
    return with_row_index(rows, name).select(name, *df.columns)


def row_query(
    df: DataFrame,
    order_by: Sequence[str] | str | None = None,
    row_numbers: Collection[int] | DataFrame | None = None,
    rowid_range: tuple[int, int] | None = None,
    rowid_set: Collection[int] | DataFrame | None = None,
    row_index: str | None = None,
    unique: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Rows at given positions, with ``row_index`` (0-based) as the first column.

    ``row_numbers`` are 0-based, ``rowid_range`` (inclusive) and ``rowid_set`` 1-based;
    the first one given counts. Positions may also be a table of one column, of any size.
    A table which already has its position passes that column as ``row_index``, and the
    query is a filter. Otherwise only those blocks of the order which hold a wanted
    position are shuffled and sorted, and a scan reads only the range of keys they span.
    """
    spark = df.sparkSession
    wanted = None
    if row_numbers is not None:
        wanted = _positions(spark, row_numbers, 0)
    elif rowid_range is not None:
        first, last = rowid_range[0] - 1, rowid_range[1] - 1
    elif rowid_set is not None:
        wanted = _positions(spark, rowid_set, 1)
    else:
        raise ValueError("give one of row_numbers, rowid_range, rowid_set")
    if wanted is not None:
        first, last = wanted.agg(F.min("__rt_wanted"), F.max("__rt_wanted")).first()
        if first is None:
            first, last = 0, -1  # none wanted

    name = row_index or "row_index"

    def pick(indexed: DataFrame) -> DataFrame:
        found = indexed.where(F.col(name).between(first, last))
        return found if wanted is None else found.join(wanted, F.col(name) == F.col("__rt_wanted"), "left_semi")

    if row_index is not None:
        return pick(df).select(name, *[c for c in df.columns if c != name])

    rows = order_rows(df, order_by, (), unique, blocks)
    table = offsets(rows)
    table = table.where((F.col("__rt_start") <= last) & (F.col("__rt_start") + F.col("__rt_count") > first))
    if wanted is not None:
        table = _holding(table, wanted, rows.total)
    # written out, the few blocks are known to be few: the others go before the shuffle
    table = stage(table, "blocks")
    if rows.borders:
        lowest, highest = table.agg(F.min(BLOCK), F.max(BLOCK)).first()
        if lowest is not None:
            rows = rows.with_df(rows.df.where(rows.borders.between(lowest, highest)))
    return pick(with_row_index(rows, name, table=table)).select(name, *df.columns)


def _positions(spark: SparkSession, positions: Collection[int] | DataFrame, base: int) -> DataFrame:
    """Different positions from 0 as ``__rt_wanted``, written out, so that their number is known."""
    if not isinstance(positions, DataFrame):
        positions = spark.createDataFrame(pd.DataFrame({"at": np.array(sorted(positions), dtype=np.int64)}), "at bigint")
    found = positions.toDF("at").selectExpr(f"cast(at as bigint) - {base} as __rt_wanted").where("__rt_wanted >= 0")
    return stage(found.distinct(), "positions")


def _holding(table: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
    """The blocks that hold a wanted position: ranges and positions meet by bins about as long as a block."""
    width = max(1, total // max(1, table.count()))
    end = F.col("__rt_start") + F.col("__rt_count") - 1
    bins = F.expr(f"sequence(__rt_start div {width}, (__rt_start + __rt_count - 1) div {width})")
    ranges = table.where("__rt_count > 0").withColumn("__rt_bin", F.explode(bins))
    at = wanted.withColumn("__rt_of", F.expr(f"__rt_wanted div {width}"))
    inside = (F.col("__rt_bin") == F.col("__rt_of")) & F.col("__rt_wanted").between(F.col("__rt_start"), end)
    return ranges.join(at, inside, "left_semi").drop("__rt_bin").distinct()


def preview(df: DataFrame, n: int) -> DataFrame:
    """Any first ``n`` rows."""
    return df.limit(n)
