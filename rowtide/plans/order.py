"""Row order without funnelling the rows through one task.

An ordered table is cut into *blocks*: ranges of the order key, or splits of a
scanned file. Everything that looks at neighbouring rows runs in two steps:

1. a window inside each block, all blocks in parallel;
2. a *block table* with one row per block (partially aggregated on the map side),
   over which the values crossing a block border are computed and joined back.

The block of a row is a pure function of the row, so both steps and any task that
is run again agree about it. Nothing is broadcast by hint: the block table is
bounded by the number of blocks, and the planner sees its size.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.plans.staging import stage

BLOCK = "__rt_block"
CHUNK = "__rt_chunk"
COPIES = "__rt_copies"
PREV = "__rt_prev"

ROWS_PER_BLOCK = 10_000  # below this a table stays in one block
MAX_BLOCKS = 16_384  # borders are constants of the plan; larger tables have longer blocks, sorted by tasks that spill
SAMPLES_PER_BLOCK = 20
COPIES_PER_CHUNK = 1_000
ROWS_PER_TASK = 500_000  # a larger table gets more tasks for a window, not larger ones


@dataclass(frozen=True)
class Borders:
    keys: tuple[str, ...]
    types: tuple[str, ...]
    texts: tuple[tuple[str | None, ...], ...]  # one list of values per key

    def between(self, first: int, last: int) -> str:
        """A filter which keeps all rows of some successive blocks, as SQL text; on a
        plain column it reaches the scan. TRUE where borders are on several columns."""
        if len(self.keys) > 1:
            return "true"
        key, parts = quoted(self.keys[0]), []
        if first > 0:
            parts.append(f"{key} >= {self._literal(first - 1)}")
        if last < len(self.texts[0]):
            below = f"{key} < {self._literal(last)}"
            parts.append(below if first > 0 else f"({below} or {key} is null)")
        return " and ".join(parts) or "true"

    def _literal(self, n: int) -> str:
        text = self.texts[0][n].replace("\\", "\\\\").replace("'", "\\'")
        return f"cast('{text}' as {self.types[0]})"


@dataclass(frozen=True)
class OrderedRows:
    """A DataFrame with its order.

    ``group``: columns at whose change the sequence starts anew; ``blocks``: block
    columns, ascending with the order; ``order``: unique order key in a block.
    ``copies`` counts the equal rows a row stands for, if they were collapsed.
    """

    df: DataFrame
    group: tuple[str, ...]
    blocks: tuple[str, ...]
    order: tuple[str, ...]
    columns: tuple[str, ...]
    copies: str | None = None
    single_block: bool = False
    total: int | None = None  # all rows, where counted
    null_groups: bool = True  # a group column may be NULL
    borders: Borders | None = None

    def with_df(self, df: DataFrame) -> OrderedRows:
        return replace(self, df=df)

    def over(self, frame: str = "") -> str:
        """Window within a block, as SQL text."""
        keys = sql_list(self.group + self.blocks)
        return f"over (partition by {keys} order by {sql_list(self.order)} {frame})"

    def position(self) -> str:
        """The order key as one comparable value, as SQL text."""
        return quoted(self.order[0]) if len(self.order) == 1 else f"struct({sql_list(self.order)})"

    def row_count(self) -> str:
        return f"sum({self.copies})" if self.copies else "count(1)"

    def repeat(self, df: DataFrame) -> DataFrame:
        """Turn collapsed rows back into as many equal rows."""
        if not self.copies:
            return df
        return df.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(self.copies).cast("int"))))


def quoted(name: str) -> str:
    """The column name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_list(names: Sequence[str]) -> str:
    return ", ".join(map(quoted, names))


def order_rows(
    df: DataFrame,
    order_by: Sequence[str] | str | None = None,
    partition_by: Sequence[str] | str = (),
    unique: bool = True,
    blocks: int | None = None,
) -> OrderedRows:
    """Give ``df`` an order and cut it into evenly filled blocks.

    ``order_by`` must be unique within ``partition_by``. Where it is not, pass
    ``unique=False``: ties are then ordered by the remaining columns. ``order_by=None``
    means all columns. If the sample shows a row with copies enough to overfill a
    block, equal rows are collapsed into counted chunks before any shuffle by block,
    so that a hot group of copies is spread like all else. Ascending, NULL first.

    Runs a count and a sample of the key columns to choose the block borders.
    """
    group = _names(partition_by)
    columns = tuple(df.columns)
    if order_by is None:
        unique = False
    order = tuple(c for c in _names(order_by or ()) if c not in group)
    if not unique:
        order += tuple(c for c in columns if c not in group and c not in order)

    rows = df.count()
    if blocks is None:
        blocks = min(MAX_BLOCKS, rows // ROWS_PER_BLOCK)

    borders = _borders(df, group + order, rows, blocks, unique) if blocks > 1 and rows else None
    collapse = borders is not None and CHUNK in borders.keys
    if collapse:
        df = _collapse_copies(df)
        order += (CHUNK,)
    df = _locate(df, borders) if borders else df.withColumn(BLOCK, F.lit(0))
    return OrderedRows(
        df=df,
        group=group,
        blocks=(BLOCK,),
        order=order,
        columns=columns,
        copies=COPIES if collapse else None,
        single_block=not borders,
        total=rows,
        borders=borders,
    )


BEFORE = "rows between unbounded preceding and 1 preceding"
UP_TO = "rows between unbounded preceding and current row"


def block_table(rows: OrderedRows, *aggregates: str) -> DataFrame:
    """One row per block (and group); aggregates as SQL text."""
    return rows.df.groupBy(*rows.group, *rows.blocks).agg(*map(F.expr, aggregates))


def over_blocks(rows: OrderedRows, frame: str = "") -> str:
    """Window over the blocks of a group, in the block table."""
    group = f"partition by {sql_list(rows.group)}" if rows.group else ""
    return f"over ({group} order by {sql_list(rows.blocks)} {frame})"


def join_blocks(
    df: DataFrame, rows: OrderedRows, table: DataFrame, values: Sequence[str], how: str
) -> DataFrame:
    """Join columns of a block table to the rows; NULL is a group like any other.

    Rows already shuffled by block for a window need no further shuffle for the join.
    """
    keys = rows.group + rows.blocks
    renamed = table.selectExpr(*[f"{quoted(c)} as __rt_k{i}" for i, c in enumerate(keys)], *values)
    safe = rows.group if rows.null_groups else ()
    same = [f"{quoted(c)} {'<=>' if c in safe else '='} __rt_k{i}" for i, c in enumerate(keys)]
    joined = df.join(renamed, F.expr(" and ".join(same)), how)
    return joined.drop(*[f"__rt_k{i}" for i in range(len(keys))])


def last_in_blocks(rows: OrderedRows, values: dict[str, str]) -> DataFrame:
    """Block table with the last non-NULL value of each expression (SQL text).

    A NULL key is a position like any other, the first one: inside ``struct`` it counts.
    """
    at = rows.position()
    if not _in_two_steps(rows):
        return block_table(
            rows, *[f"max_by({e}, case when {e} is not null then struct({at}) end) as {n}" for n, e in values.items()]
        )
    # keeping texts or structs while aggregating means sorting all rows by block;
    # numbers are aggregated by hash. So find the places first, then fetch their rows
    spots = [f"__rt_p{i}" for i in range(len(values))]
    places = block_table(
        rows, *[f"max(case when {e} is not null then {at} end) as {p}" for p, e in zip(spots, values.values())]
    )
    places = stage(places, "places")
    hits = join_blocks(rows.df, rows, places, spots, "inner")
    hits = hits.where(" or ".join(f"{at} <=> {p}" for p in spots))
    found = block_table(
        rows.with_df(hits),
        *[f"max_by({e}, case when {at} <=> {p} and {e} is not null then struct({at}) end) as {n}" for p, (n, e) in zip(spots, values.items())],
    )
    # a block without any value has no hit, but takes on what is carried into it
    return join_blocks(places.drop(*spots), rows, found, list(values), "left")


def _in_two_steps(rows: OrderedRows) -> bool:
    """A single number or time as order key, and few groups: as many places as blocks,
    small enough to be broadcast."""
    by_number = isinstance(
        rows.df.schema[rows.order[0]].dataType, (T.IntegralType, T.TimestampType, T.TimestampNTZType, T.DateType)
    )
    few_groups = not rows.group or not rows.null_groups  # none, or files
    return len(rows.order) == 1 and by_number and few_groups


def carried(rows: OrderedRows, values: dict[str, str]) -> DataFrame:
    """Block table with the last non-NULL value of each expression in earlier blocks.

    Only blocks which continue a group are kept: at most one row per block border,
    however many groups there are.
    """
    table = last_in_blocks(rows, values)
    return table.selectExpr(
        *map(quoted, rows.group + rows.blocks),
        *[f"last({n}, true) {over_blocks(rows, BEFORE)} as {n}" for n in values],
        f"row_number() {over_blocks(rows)} as __rt_nth",
    ).where("__rt_nth > 1")


def fill_forward(rows: OrderedRows, values: dict[str, Column]) -> DataFrame:
    """For each name, the last non-NULL value up to and including the row."""
    cells = [f"__rt_v{i}" for i in range(len(values))]
    others = [quoted(c) for c in rows.df.columns if c not in values]
    df = rows.df.withColumns(dict(zip(cells, values.values())))
    local = dealt(rows, df).selectExpr(
        *others,
        *[f"last({c}, true) {rows.over(UP_TO)} as {quoted(n)}" for n, c in zip(values, cells)],
    )
    if rows.single_block:
        return local
    table = carried(rows.with_df(df), {c: c for c in cells})
    joined = join_blocks(local, rows, table, cells, "left")
    return joined.selectExpr(
        *others, *[f"coalesce({quoted(n)}, {c}) as {quoted(n)}" for n, c in zip(values, cells)]
    )


def dealt(rows: OrderedRows, df: DataFrame) -> DataFrame:
    """``df`` shuffled by block as its windows need it, if Spark's own number of tasks would
    give them more than ``ROWS_PER_TASK`` rows each."""
    tasks = (rows.total or 0) // ROWS_PER_TASK
    if rows.single_block or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *[F.col(quoted(c)) for c in rows.group + rows.blocks])


def with_previous(rows: OrderedRows, columns: Sequence[str]) -> DataFrame:
    """Add ``PREV``, a struct of the columns in the row above; NULL in the first row."""
    cells = f"struct({sql_list(columns)})"
    local = rows.df.selectExpr("*", f"lag({cells}) {rows.over()} as {PREV}")
    if rows.single_block:
        return local
    table = carried(rows, {"__rt_last": cells})
    joined = join_blocks(local, rows, table, ["__rt_last"], "left")
    return joined.withColumn(PREV, F.coalesce(PREV, "__rt_last")).drop("__rt_last")


def offsets(rows: OrderedRows) -> DataFrame:
    """Block table with ``__rt_start`` (rows before the block), ``__rt_count`` and the
    rows of the whole group, ``__rt_total``."""
    table = block_table(rows, f"{rows.row_count()} as __rt_count")
    everywhere = "rows between unbounded preceding and unbounded following"
    return table.selectExpr(
        "*",
        f"coalesce(sum(__rt_count) {over_blocks(rows, BEFORE)}, 0) as __rt_start",
        f"sum(__rt_count) {over_blocks(rows, everywhere)} as __rt_total",
    )


def with_row_index(
    rows: OrderedRows,
    name: str = "row_index",
    total: str | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """Add the contiguous 0-based position, and on request the size of the group.

    A ``table`` holding some of the blocks restricts the work to those blocks: rows
    of other blocks are dropped before the shuffle. Collapsed copies come back as
    single rows.
    """
    if table is None:
        table = offsets(rows)
    df = join_blocks(rows.df, rows, table, ["__rt_start", "__rt_total"], "inner")
    if rows.copies:
        within = f"coalesce(sum({rows.copies}) {rows.over(BEFORE)}, 0)"
    else:
        within = f"cast(row_number() {rows.over()} as bigint) - 1"
    df = df.withColumn(name, F.expr(f"__rt_start + {within}"))
    df = rows.repeat(df)
    if rows.copies:
        df = df.withColumn(name, F.col(name) + F.col(COPIES) - 1)
    if total:
        df = df.withColumn(total, F.col("__rt_total"))
    return df.drop("__rt_start", "__rt_total")


def _names(columns: Sequence[str] | str) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


def _collapse_copies(df: DataFrame) -> DataFrame:
    """Equal rows become one row per ``COPIES_PER_CHUNK`` copies, counted."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__rt_n"))
    size = COPIES_PER_CHUNK
    chunked = counted.selectExpr("*", f"explode(sequence(0L, (__rt_n - 1) div {size})) as {CHUNK}")
    return chunked.selectExpr(
        *map(quoted, df.columns), CHUNK, f"least({size}, __rt_n - {CHUNK} * {size}) as {COPIES}"
    )


def _borders(
    df: DataFrame, keys: tuple[str, ...], rows: int, blocks: int, unique: bool
) -> Borders | None:
    """Evenly spaced values of the shortest sufficient prefix of the order key.

    A prefix will do when none of its values holds more than two blocks' worth of
    rows; beyond the whole key there are only copies to be told apart, by chunk. The
    sample has ``SAMPLES_PER_BLOCK`` rows per block, whatever the table's size, and
    its sorted keys are what reaches the driver.
    """
    fraction = min(1.0, blocks * SAMPLES_PER_BLOCK / rows)
    sample = df.select(*keys)
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=7)
    sample = sample.persist()
    try:
        for length in range(1, len(keys) + 1):
            prefix = keys[:length]
            counted = _counted(sample, prefix)
            size = sum(r["__rt_n"] for r in counted)
            per_block = max(1, size // blocks)
            if max((r["__rt_n"] for r in counted), default=0) <= 2 * per_block:
                break
        else:
            if not unique:
                # the j-th equal row of the sample stands for the copies around j / fraction
                nth = f"(row_number() over (partition by {sql_list(keys)} order by 1) - 1)"
                chunk = F.expr(f"floor({nth} / {fraction!r}D / {COPIES_PER_CHUNK})")
                prefix = keys + (CHUNK,)
                counted = _counted(sample.withColumn(CHUNK, chunk), prefix)
        types = tuple("bigint" if k == CHUNK else sample.schema[k].dataType.simpleString() for k in prefix)
    finally:
        sample.unpersist()
    cuts, filled = [], 0
    for r in counted:
        if filled >= per_block and (len(prefix) > 1 or r[0] is not None):
            cuts.append(tuple(r)[:-1])
            filled = 0
        filled += r["__rt_n"]
    return Borders(prefix, types, tuple(zip(*cuts))) if cuts else None


def _counted(sample: DataFrame, prefix: tuple[str, ...]) -> list:
    """Values of a key prefix in the sample with their counts, in order, as text."""
    return (
        sample.groupBy(*prefix)
        .agg(F.count(F.lit(1)).alias("__rt_n"))
        .coalesce(1)
        .sortWithinPartitions(*prefix)
        .selectExpr(*[f"cast({quoted(k)} as string)" for k in prefix], "__rt_n")
        .collect()
    )


def _locate(df: DataFrame, borders: Borders) -> DataFrame:
    """Add the block number: how many borders are at or below the row's key.

    Binary search over constant arrays, as one expression whose size does not depend on
    the number of borders: filters that the optimizer moves below it repeat the whole
    expression, so a step must not name the step before more than once. Any ascending
    borders are right, so text is a safe form to pass them in.
    """
    # each read and cast as a whole, so that the borders are a constant, computed once for the plan
    if len(borders.keys) == 1:
        text, cells, type_ = list(borders.texts[0]), "string", borders.types[0]
        key = F.col(quoted(borders.keys[0]))
    else:
        names = [f"k{i}" for i in range(len(borders.keys))]
        text = [dict(zip(names, values)) for values in zip(*borders.texts)]
        cells = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
        type_ = "struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, borders.types)) + ">"
        key = F.struct(*[F.col(quoted(k)).alias(n) for k, n in zip(borders.keys, names)])
    bounds = F.sort_array(F.from_json(F.lit(json.dumps(text)), f"array<{cells}>").cast(f"array<{type_}>"))
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(borders.texts[0]).bit_length()))])

    def found(value: Column) -> Column:
        # beyond the last border there is NULL, which is not below the key
        def further(block: Column, step: Column) -> Column:
            return F.when(F.get(bounds, block + step - 1) <= value, block + step).otherwise(block)

        return F.aggregate(steps, F.lit(0), further)

    return df.withColumn(BLOCK, F.coalesce(F.get(F.transform(F.array(key), found), F.lit(0)), F.lit(0)))
