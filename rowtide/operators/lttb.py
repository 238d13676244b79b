"""Largest-Triangle-Three-Buckets downsampling of time series, exact and distributed.

Points are put in time order and cut into buckets; from each bucket the point is kept
that spans the largest triangle with the point kept before and the mean of the next
bucket. Each choice needs the one before, a chain over the buckets. Two facts keep
the chain small: the means are plain sums, and the area is the absolute value of a
linear function of the candidate, so only points on the bucket's convex hull can win.
Hulls are pruned in every task on its own rows. What is left is sorted by series and
bucket, the sums of the next bucket before a bucket's points, and walked as a stream: a task
holds one point and one candidate of the series it is at, however long that is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.typing import parsed
from rowtide.plans.order import order_rows, with_row_index
from rowtide.plans.staging import stage

_PRUNE_ROWS = 20_000
_EMIT_ROWS = 40_000


def lttb(
    df: DataFrame,
    sample_size: int,
    time_field: str,
    value_field: str,
    key: Sequence[str] | str,
    partition_by: Sequence[str] | str = (),
    blocks: int | None = None,
) -> DataFrame:
    """``sample_size`` rows per series which keep its shape, peaks and ends included.

    ``key`` identifies a row within its series (``partition_by``) and orders points of
    equal time. Rows without a finite numeric time and value are no points and never
    come out. A series with no more points than asked for is kept whole; a sample
    below 3 takes the first points. Equal areas: the earliest point wins.
    """
    if sample_size <= 0:
        raise ValueError(f"sample_size must be above 0, not {sample_size}")
    key = [key] if isinstance(key, str) else list(key)
    series = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    points = df.select(
        *[F.col(c).alias(f"s{i}") for i, c in enumerate(series)],
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)],
        _number(df, time_field).alias("x"),
        _number(df, value_field).alias("y"),
    ).where("x > -double('inf') and x < double('inf') and y > -double('inf') and y < double('inf')")
    s_cols = [f"s{i}" for i in range(len(series))]
    k_cols = [f"k{i}" for i in range(len(key))]

    rows = order_rows(points, ["x", *k_cols], s_cols, blocks=blocks)
    indexed = with_row_index(rows, "i", total="n").select(*s_cols, *k_cols, "x", "y", "i", "n")
    if not series and rows.total <= sample_size:
        chosen = points
    elif sample_size < 3:
        chosen = indexed.where(F.col("i") < sample_size)
    else:
        chosen = _chained(indexed.where(F.col("n") > sample_size), s_cols, k_cols, sample_size)
        if series:
            whole = indexed.where(F.col("n") <= sample_size)
            chosen = whole.select(*s_cols, *k_cols).unionByName(chosen)
    # written out, the few points chosen have a known size, and df is not shuffled
    chosen = stage(chosen.select(*s_cols, *k_cols), "lttb-chosen")
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(series, s_cols)]
    same += [F.col(c) == F.col(n) for c, n in zip(key, k_cols)]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return df.join(chosen, condition, "left_semi")


def _number(df: DataFrame, name: str) -> Column:
    type_, cell = df.schema[name].dataType, F.col(name)
    if isinstance(type_, T.StringType):
        return parsed(cell, "double")
    if isinstance(type_, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(cell.cast("timestamp")).cast("double")
    if isinstance(type_, (T.NumericType, T.BooleanType)):
        return cell.cast("double")
    raise TypeError(f"lttb needs numbers or times, '{name}' is {type_.simpleString()}")


def _chained(
    indexed: DataFrame, s_cols: list[str], k_cols: list[str], size: int
) -> DataFrame:
    inner, i, n = size - 2, F.col("i"), F.col("n")
    # bucket b holds the inner points floor((b-1)(n-2)/inner) .. floor(b(n-2)/inner) - 1,
    # in whole numbers; the first and the last point are buckets of their own
    bucket = F.when(i == 0, F.lit(0)).when(i == n - 1, F.lit(inner + 1))
    bucket = bucket.otherwise(F.floor(F.expr(f"(i * {inner} - 1) div (n - 2)") + 1)).cast("int")
    points = indexed.select(*s_cols, *k_cols, bucket.alias("b"), "i", "x", "y")
    groups = [*s_cols, "b"]
    schema = T.StructType(list(points.schema.fields))
    for name, type_ in (("kind", T.IntegerType()), ("points", T.LongType()), ("sx", T.DoubleType()), ("sy", T.DoubleType())):
        schema = schema.add(name, type_)

    candidates = stage(points.mapInPandas(lambda batches: pruned_batches(batches, groups), schema), "lttb")
    names = s_cols + k_cols
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.repartition(parts, *s_cols) if s_cols else candidates.repartition(1)
    ordered = dealt.sortWithinPartitions(*s_cols, "b", "kind", "i")
    kept = T.StructType([f for f in candidates.schema.fields if f.name in names])
    return ordered.mapInPandas(lambda batches: walk(batches, names), kept)


def pruned_batches(batches: Iterator[pd.DataFrame], groups: list[str]) -> Iterator[pd.DataFrame]:
    """The points left of a task's rows, given out whenever ``_EMIT_ROWS`` of them are held."""
    held: list[pd.DataFrame] = []
    rows, limit = 0, _PRUNE_ROWS
    for pdf in batches:
        held.append(_with_sums(pdf))
        rows += len(pdf)
        if rows >= limit:
            pruned = _pruned(pd.concat(held, ignore_index=True), groups)
            held, rows = [pruned], len(pruned)
            limit = max(_PRUNE_ROWS, 2 * rows)
            if rows >= _EMIT_ROWS:
                yield _for_walk(pruned)
                held, rows, limit = [], 0, _PRUNE_ROWS
    if held:
        yield _for_walk(_pruned(pd.concat(held, ignore_index=True), groups))


def _for_walk(pruned: pd.DataFrame) -> pd.DataFrame:
    """Candidates as kind 1, and the sums of each bucket as kind 0 of the bucket before."""
    sums = pruned[(pruned["points"] > 0) & (pruned["b"] > 0)]
    return pd.concat([sums.assign(b=sums["b"] - 1, i=-1, kind=0), pruned.assign(kind=1)], ignore_index=True)


def _with_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every point counts itself; pruned points leave their sums to a point kept."""
    return pdf.assign(points=1, sx=pdf["x"], sy=pdf["y"])


def _pruned(pdf: pd.DataFrame, groups: list[str]) -> pd.DataFrame:
    """Only points that may lie on the hull of their bucket; the first point kept of
    each bucket takes over the sums of all."""
    code = pdf.groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((pdf["i"].to_numpy(), code))
    pdf, code = pdf.iloc[order], code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.array([], int)
    sums = {c: np.add.reduceat(pdf[c].to_numpy(), first) for c in ("points", "sx", "sy")} if len(code) else {}
    keep = hull_candidates(code, pdf["x"].to_numpy(), pdf["y"].to_numpy())
    keep[first] = True
    pdf = pdf[keep]
    at = np.flatnonzero(np.r_[True, code[keep][1:] != code[keep][:-1]]) if len(pdf) else first
    heads = {c: np.zeros(len(pdf), dtype=v.dtype) for c, v in sums.items()}
    for c, v in sums.items():
        heads[c][at] = v
    return pdf.assign(**heads)


def hull_candidates(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mask of points not strictly inside the hull of their group.

    Points must be sorted by group and x. A point strictly below the line through its
    neighbours cannot be on the upper hull, so all such points go at once, again and
    again until none is left; likewise for the lower hull. Points within rounding of
    the line stay.
    """
    keep = np.zeros(len(code), dtype=bool)
    ends = _extremes(code, x, y)
    for sign in (1.0, -1.0):
        index = ends
        while len(index) > 2:
            a, b, c = index[:-2], index[1:-1], index[2:]
            left, right = (x[b] - x[a]) * (y[c] - y[a]), (x[c] - x[a]) * (y[b] - y[a])
            slack = 1e-12 * (np.abs(left) + np.abs(right))
            inside = (code[a] == code[c]) & (sign * (left - right) > slack)
            if not inside.any():
                break
            index = np.delete(index, np.flatnonzero(inside) + 1)
        keep[index] = True
    return keep


def _extremes(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the lowest and the highest value of each group and time, the first of each.

    For one time the area is linear in the value before its sign is dropped, so nothing
    between them is larger.
    """
    if not len(code):
        return np.arange(0)
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (x[1:] != x[:-1])])
    sizes = np.diff(np.r_[first, len(code)])
    found = []
    for end in (np.minimum, np.maximum):
        at = np.flatnonzero(y == np.repeat(end.reduceat(y, first), sizes))
        run = np.searchsorted(first, at, side="right")
        found.append(at[np.r_[True, run[1:] != run[:-1]]])
    return np.union1d(*found)


def walk(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """One point of each bucket, from series that are sorted by bucket, kind and place.

    A series begins with bucket 0. A bucket's rows may be spread over batches: only the
    point kept last, the next bucket's sums and the best point so far are held.
    """
    bucket, at, best, largest, sums = -1, None, None, -1.0, np.zeros(3)
    for rows in batches:
        b, kind, x, y = (rows[c].to_numpy() for c in ("b", "kind", "x", "y"))
        weights = rows[["points", "sx", "sy"]].to_numpy(dtype=np.float64)
        cells = [rows[c].array for c in names]
        edges = np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
        kept: list[tuple] = []
        for lo, hi in zip([0, *edges], [*edges, len(b)]):
            if b[lo] != bucket:
                if best is not None:
                    kept.append(best[0])
                    at = best[1]
                if b[lo] == 0:
                    at = None
                bucket, best, largest, sums = b[lo], None, -1.0, np.zeros(3)
            if kind[lo] == 0:
                sums = sums + weights[lo:hi].sum(axis=0)
                continue
            if at is None or not sums[0]:
                if best is None:  # the first and the last bucket have one point
                    best = tuple(c[lo] for c in cells), (x[lo], y[lo])
                continue
            areas = _areas(at, x[lo:hi], y[lo:hi], sums[1:] / sums[0])
            pick = int(np.argmax(areas))
            if areas[pick] > largest:
                largest = areas[pick]
                best = tuple(c[lo + pick] for c in cells), (x[lo + pick], y[lo + pick])
        yield pd.DataFrame(kept, columns=names).astype(rows[names].dtypes)
    if best is not None:
        yield pd.DataFrame([best[0]], columns=names).astype(rows[names].dtypes)


def _areas(a, x, y, c):
    """Twice the areas of the triangles between ``a``, each point and ``c``."""
    return np.abs((a[0] - c[0]) * (y - a[1]) - (a[0] - x) * (c[1] - a[1]))
