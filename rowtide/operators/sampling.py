"""Repeatable samples: pure functions of the seed and the row's key.

A row's place in a sample follows from ``md5(seed:key)``, so a sample does not depend
on partitioning, on the order of rows or on tasks run again. Keys must be unique
(equal keys are picked together) and of integer or text type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.operators.lookup import add_row_index
from rowtide.operators.lttb import lttb
from rowtide.plans.staging import stage

_DIGITS = 3  # hex digits of a hash by which rows are counted at a time
_NULL_KEY = "\x00null"  # stands for NULL in hashed keys; md5 of NULL would be NULL


def row_hash(seed: int, key: Sequence[str] | str) -> Column:
    """32 hex digits, uniform over the rows."""
    names = [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(_NULL_KEY)) for c in names]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bernoulli(df: DataFrame, probability: float, key: Sequence[str] | str, seed: int = 0) -> DataFrame:
    """Each row independently with the given probability. A filter: works on streams."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError(f"probability must be between 0 and 1, not {probability}")
    limit = int(probability * 2**32)
    if limit >= 2**32:
        return df
    return df.where(F.substring(row_hash(seed, key), 1, 8) < f"{limit:08x}")


def bernoulli_fast(df: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    """Spark's own sampler: cheaper, but depends on how the rows are partitioned."""
    if not 0.0 <= probability <= 1.0:
        raise ValueError(f"probability must be between 0 and 1, not {probability}")
    return df.sample(withReplacement=False, fraction=probability, seed=seed)


def reservoir(df: DataFrame, size: int, key: Sequence[str] | str, seed: int = 0) -> DataFrame:
    """``size`` rows, uniformly and without replacement; all rows if there are fewer."""
    if size <= 0:
        raise ValueError(f"size must be above 0, not {size}")
    return _smallest(df, row_hash(seed, key), size, _names(key))


def systematic(
    df: DataFrame,
    block_size: int,
    order_by: Sequence[str] | str | None = None,
    seed: int = 0,
    start: int | None = None,
    row_index: str | None = None,
    unique: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Every ``block_size``-th row in the given order from a start drawn by the seed."""
    if block_size <= 0:
        raise ValueError(f"block_size must be above 0, not {block_size}")
    if start is None:
        start = systematic_start(block_size, seed)
    if not 0 <= start < block_size:
        raise ValueError(f"start must be in [0, {block_size}), not {start}")
    name = row_index or "__rt_index"
    indexed = df if row_index else add_row_index(df, order_by, name, unique, blocks)
    return indexed.where(F.col(name) % block_size == start).select(*df.columns)


def systematic_start(block_size: int, seed: int) -> int:
    """The start position in ``[0, block_size)`` for a seed."""
    return int(hashlib.md5(f"{seed}:start".encode()).hexdigest(), 16) % block_size


def cluster(
    df: DataFrame,
    field: str,
    n_clusters: int | None = None,
    sample_size: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """All rows of ``n_clusters`` keys drawn at random; NULL is a key.

    ``n_clusters`` wins over ``sample_size``. The drawn keys are written out first, so
    the planner knows their true size: if small they are broadcast and no row is
    shuffled, else the join is by shuffle.
    """
    n = n_clusters if n_clusters is not None else sample_size
    if n is None or n <= 0:
        raise ValueError("n_clusters or sample_size must be above 0")
    keys = df.select(F.col(field).alias("__rt_key")).distinct()
    chosen = stage(_smallest(keys, row_hash(seed, "__rt_key"), n, ["__rt_key"]), "clusters")
    return df.join(chosen, F.col(field).eqNullSafe(F.col("__rt_key")), "left_semi")


def sample(df: DataFrame, method: str, **options) -> DataFrame:
    """Dispatch by name: bernoulli, reservoir, system, cluster, lttb."""
    methods = {
        "bernoulli": bernoulli,
        "reservoir": reservoir,
        "system": systematic,
        "cluster": cluster,
        "lttb": lttb,
    }
    if method not in methods:
        raise ValueError(f"unknown sampling method {method!r}: use one of {sorted(methods)}")
    return methods[method](df, **options)


def _smallest(df: DataFrame, hash_: Column, size: int, key: list[str]) -> DataFrame:
    """The ``size`` rows with the smallest hash; of rows with one hash, and so one key, any.

    Rows are counted by the leading zero bits of their hash (at most 49 numbers). The
    most zero bits that still leave ``size`` rows pass about twice ``size`` rows, which are
    written out. Of these the border is found by counts of hash prefixes, three digits
    longer each time within the one group that the border cuts. No rows are sorted, and
    none are gathered in one task.
    """
    level = F.lit(48) - F.length(F.bin(F.conv(F.substring(hash_, 1, 12), 16, 10).cast("bigint")))
    levels = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    kept, enough = 0, None
    for r in sorted(levels, reverse=True):
        kept += r["n"]
        if kept >= size:
            enough = r["level"]
            break
    if enough is None:
        return df
    mark = "__rt_hash"
    rows = stage(df.where(level >= enough).withColumn(mark, hash_), "smallest")
    border, taken = "", 0
    for digits in range(_DIGITS, 32 + _DIGITS, _DIGITS):
        prefix = F.substring(mark, 1, digits)
        counts = rows.where(F.startswith(mark, F.lit(border))).groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(counts.collect()):  # at most 16 to the power of _DIGITS
            border = r["prefix"]
            if taken + r["n"] > size:
                break
            taken += r["n"]
            if taken == size:
                return rows.where(prefix <= border).drop(mark)
    below = rows.where(F.col(mark) < border)
    return below.union(rows.where(F.col(mark) == border).limit(size - taken)).drop(mark)


def _names(key: Sequence[str] | str) -> list[str]:
    return [key] if isinstance(key, str) else list(key)
