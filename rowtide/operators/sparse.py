"""Expand and sparsify: the value above, taken over or left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.markers import Inherit, inherits
from rowtide.functions.text import to_text
from rowtide.functions.typing import NULL_VALUES, null_mapped
from rowtide.plans.order import (
    CHUNK,
    COPIES,
    PREV,
    OrderedRows,
    fill_forward,
    order_rows,
    quoted,
    with_previous,
)

NULL_TOKEN = "NULL"


def expand_sparse(
    df: DataFrame,
    order_by: Sequence[str] | str,
    cols: Sequence[str] | None = None,
    partition_by: Sequence[str] | str = (),
    inherit: Inherit = "whitespace",
    null_values: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Replace each inherit marker by the last value above it.

    Text cells are markers by ``inherit``; cells of other types where they are NULL.
    Markers with no value above become NULL. ``null_values`` are tokens of text
    cells turned into NULL after the fill: they stop inheritance.
    """
    rows = order_rows(df, order_by, partition_by, blocks=blocks)
    fixed = set(rows.group + rows.order)
    cols = [c for c in df.columns if c not in fixed] if cols is None else list(cols)
    return expand_rows(rows, cols, inherit, null_values).select(*df.columns)


def expand_rows(
    rows: OrderedRows,
    cols: Sequence[str],
    inherit: Inherit = "whitespace",
    null_values: Sequence[str] = (),
) -> DataFrame:
    """:func:`expand_sparse` on rows whose order is already known."""
    text = {c for c in cols if isinstance(rows.df.schema[c].dataType, T.StringType)}
    values = {
        c: F.when(~inherits(F.col(c), inherit), F.col(c)) if c in text else F.col(c) for c in cols
    }
    filled = fill_forward(rows, values)
    if null_values:
        filled = filled.withColumns({c: null_mapped(F.col(c), null_values) for c in text})
    return filled


def repeats_above(rows: OrderedRows, cols: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Rows with, as SQL text per column, whether the cell equals the one above.

    NULL equals NULL and NaN equals NaN. The first row repeats nothing; the second and
    later ones of collapsed copies repeat everything.
    """
    later_copy = f"{CHUNK} > 0" if rows.copies else "false"
    return with_previous(rows, cols), {
        c: f"({later_copy} or ({PREV} is not null and {quoted(c)} <=> {PREV}.{quoted(c)}))" for c in cols
    }


def sparsify(
    df: DataFrame,
    order_by: Sequence[str] | str | None = None,
    cols: Sequence[str] | None = None,
    partition_by: Sequence[str] | str = (),
    unique: bool = True,
    marker: str = "",
    null_token: str = NULL_TOKEN,
    null_values: Sequence[str] = NULL_VALUES,
    inherit: Inherit = "whitespace",
    on_ambiguous: str = "raise",
    blocks: int | None = None,
) -> DataFrame:
    """Write ``marker`` for each cell equal to the one above, else the text form.

    NULL becomes ``null_token``. A text value which the reading side would take for a
    marker or for NULL (by ``inherit`` and ``null_values``) cannot be told apart in
    the result: it raises, or is written as it is with ``on_ambiguous="keep"``.
    """
    rows = order_rows(df, order_by, partition_by, unique, blocks)
    if cols is None:
        keep = set(rows.group) | set(rows.order if order_by is not None and unique else ())
        cols = [c for c in df.columns if c not in keep]
    cells = sparse_rows(rows, list(cols), marker, null_token, null_values, inherit, on_ambiguous)
    return cells.select(*df.columns)


def sparse_rows(
    rows: OrderedRows,
    cols: Sequence[str],
    marker: str = "",
    null_token: str = NULL_TOKEN,
    null_values: Sequence[str] = NULL_VALUES,
    inherit: Inherit = "whitespace",
    on_ambiguous: str = "raise",
    line_breaks: bool = True,
) -> DataFrame:
    """:func:`sparsify` on rows whose order is already known."""
    if null_token not in null_values:
        raise ValueError(f"null_token {null_token!r} is not among null_values")
    if on_ambiguous not in ("raise", "keep"):
        raise ValueError(f"on_ambiguous must be 'raise' or 'keep', not {on_ambiguous!r}")
    types = {c: rows.df.schema[c].dataType for c in cols}
    df, repeats = repeats_above(rows, cols)
    written = {}
    for c in cols:
        text = to_text(F.col(c), types[c])
        if on_ambiguous == "raise" and isinstance(types[c], T.StringType):
            clash = inherits(F.col(c), inherit) | F.col(c).isin(*null_values)
            message = F.concat(F.lit(f"column '{c}': '"), F.col(c), F.lit("' would be read as a marker or NULL"))
            text = F.when(clash, F.raise_error(message).cast("string")).otherwise(F.col(c))
        if not line_breaks and isinstance(types[c], T.StringType):
            message = F.lit(f"column '{c}' has line breaks: write it with multi_line=True")
            broken = F.col(c).contains("\n") | F.col(c).contains("\r")
            text = F.when(broken, F.raise_error(message).cast("string")).otherwise(text)
        value = F.when(F.col(c).isNull(), F.lit(null_token)).otherwise(text)
        written[f"__rt_w_{c}"] = F.when(F.expr(repeats[c]), F.lit(marker)).otherwise(value)
    df = rows.repeat(df.withColumns(written))
    cells = {c: F.col(f"__rt_w_{c}") for c in cols}
    if rows.copies:
        cells = {c: F.when(F.col(COPIES) > 1, F.lit(marker)).otherwise(v) for c, v in cells.items()}
    return df.withColumns(cells).drop(*written, PREV)


def sparsity_stats(
    df: DataFrame,
    order_by: Sequence[str] | str | None = None,
    cols: Sequence[str] | None = None,
    unique: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Per column: rows, cells the sparse form leaves out, and the bytes this saves."""
    rows = order_rows(df, order_by, (), unique, blocks)
    cols = list(df.columns if cols is None else cols)
    types = {c: df.schema[c].dataType for c in cols}
    flagged, repeats = repeats_above(rows, cols)
    weight = rows.copies or "1"
    for c in cols:
        to_text(F.col(quoted(c)), types[c])  # refuses types without a text form
    flagged = flagged.selectExpr(
        f"cast({weight} as bigint) as __rt_rows",
        *[f"cast(case when {repeats[c]} then {weight} else {weight} - 1 end as bigint) as e{i}" for i, c in enumerate(cols)],
        *[
            f"cast(octet_length(coalesce(cast({quoted(c)} as string), '{NULL_TOKEN}')) as bigint) as b{i}"
            for i, c in enumerate(cols)
        ],
    )
    n = len(cols)
    totals = flagged.selectExpr(
        "coalesce(sum(__rt_rows), 0) as n",
        *[f"coalesce(sum(e{i}), 0) as e{i}" for i in range(n)],
        *[f"coalesce(sum(e{i} * b{i}), 0) as b{i}" for i in range(n)],
    )
    names = [c.replace("\\", "\\\\").replace("'", "\\'") for c in cols]
    lines = ", ".join(f"'{c}', n, e{i}, b{i}" for i, c in enumerate(names))
    return totals.selectExpr(f"stack({n}, {lines}) as (column, rows, cells_elided, bytes_saved)")


def compare_orders(
    df: DataFrame,
    orders: Sequence[Sequence[str]],
    cols: Sequence[str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Totals of :func:`sparsity_stats` for each candidate sort order.

    Ties of an order are sorted by the remaining columns.
    """
    result = None
    for order in orders:
        stats = sparsity_stats(df, order, cols, unique=False, blocks=blocks)
        line = stats.agg(
            F.max("rows").alias("rows"),
            F.sum("cells_elided").alias("cells_elided"),
            F.sum("bytes_saved").alias("bytes_saved"),
        ).select(F.lit(",".join(order)).alias("sort_order"), "*")
        result = line if result is None else result.unionAll(line)
    return result
