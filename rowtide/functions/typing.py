"""From text cells to typed columns: NULL tokens, hints, inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: tokens read as NULL
NULL_VALUES = ("", "NULL", "null", "None", "NA", "N/A")
# fixed values: words read as true and as false
TRUE_WORDS = ("true", "True", "TRUE", "yes", "Yes", "YES", "1")
FALSE_WORDS = ("false", "False", "FALSE", "no", "No", "NO", "0")

# number forms; a failing cast costs far more than a pattern, and Java's own parser
# would also take "1d" and "0x1p3"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"

_HINTS = {
    int: "bigint",
    float: "double",
    bool: "boolean",
    str: "string",
    "int": "bigint",
    "long": "bigint",
    "float": "double",
    "bool": "boolean",
    "str": "string",
}
TYPES = ("bigint", "double", "boolean", "string")


def type_name(hint) -> str:
    """One of the four column types for a Python type, short name or Spark type."""
    if isinstance(hint, T.DataType):
        hint = hint.simpleString()
    name = _HINTS.get(hint, hint)
    if name not in TYPES:
        raise ValueError(f"unsupported type hint {hint!r}: use one of {TYPES}")
    return name


def null_mapped(cell: Column, null_values: Sequence[str] = NULL_VALUES) -> Column:
    """NULL where the cell is exactly one of the tokens."""
    if not null_values:
        return cell
    return F.when(~cell.isin(*null_values), cell)


def parsed(cell: Column, type_: str, sure: bool = False) -> Column:
    """The cell under a type, NULL where it does not have that form.

    ``sure``: every cell is known to have it, as after inference.
    """
    if sure and type_ in ("bigint", "double"):
        return cell.try_cast(type_)
    if type_ == "bigint":
        return F.when(cell.rlike(_INTEGER), cell).try_cast("bigint")
    if type_ == "double":
        return F.when(cell.rlike(_FLOAT), cell).try_cast("double")
    if type_ == "boolean":
        return F.when(cell.isin(*TRUE_WORDS), True).when(cell.isin(*FALSE_WORDS), False)
    return cell


def hinted(
    cell: Column, type_: str, column: str, row: Column | None = None, on_error: str = "raise"
) -> Column:
    """The cell under a type given by the caller.

    A cell without that form raises, naming row and column, or becomes NULL with
    ``on_error="null"``.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be 'raise' or 'null', not {on_error!r}")
    value = parsed(cell, type_)
    if on_error == "null" or type_ == "string":
        return value
    where = F.concat(F.lit("row "), row.cast("string"), F.lit(", ")) if row is not None else F.lit("")
    message = F.concat(where, F.lit(f"column '{column}': cannot read '"), cell, F.lit(f"' as {type_}"))
    return F.when(
        cell.isNotNull(), F.coalesce(value, F.raise_error(message).cast(type_))
    )


def infer_types(
    df: DataFrame, cells: Mapping[str, Column] | None = None
) -> dict[str, str]:
    """The narrowest of bigint, double, boolean, string that every non-NULL cell of a
    column has, in one aggregation over the whole table. A column without any value
    is a string.

    ``cells`` maps column names to text expressions with NULL tokens already mapped;
    default: the columns of ``df`` with the default tokens.
    """
    if cells is None:
        cells = {c: null_mapped(F.col(c)) for c in df.columns}
    if not cells:
        return {}
    # per cell the types it fits, as bits 1, 2, 4; a column has those all its cells share
    both = ", ".join(f"'{w}'" for w in ("1", "0"))
    words = ", ".join(f"'{w}'" for w in TRUE_WORDS + FALSE_WORDS)
    fits = (
        "case when {c} is null then null"
        f" when {{c}} rlike r'{_INTEGER}' and (length({{c}}) < 19 or try_cast({{c}} as bigint) is not null)"
        f" then if({{c}} in ({both}), 7, 3)"
        f" when {{c}} in ({words}) then 4"
        f" when {{c}} rlike r'{_FLOAT}' then 2 else 0 end"
    )
    n = len(cells)
    texts = df.select(*[cell.alias(f"c{i}") for i, cell in enumerate(cells.values())])
    shared = texts.selectExpr(*[f"{fits.replace('{c}', f'c{i}')} as f{i}" for i in range(n)]).agg(
        *[F.expr(f"bit_and(f{i})") for i in range(n)]
    )
    result = {}
    for name, bits in zip(cells, shared.first()):
        fitting = [t for t, bit in zip(TYPES, (1, 2, 4)) if bits and bits & bit]
        result[name] = fitting[0] if fitting else "string"
    return result


def typed_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    type_hints: Mapping[str, object] | None = None,
    infer: bool = True,
    null_values: Sequence[str] = NULL_VALUES,
    row: str | None = None,
    on_error: str = "raise",
) -> DataFrame:
    """Type the text columns of ``df``: NULL tokens first, then hints, then inference."""
    columns = list(columns or df.columns)
    hints = {c: type_name(t) for c, t in (type_hints or {}).items()}
    unknown = set(hints) - set(columns)
    if unknown:
        raise ValueError(f"type hints for unknown columns: {sorted(unknown)}")
    cells = {c: null_mapped(F.col(f"`{c}`"), null_values) for c in columns}
    inferred = infer_types(df, {c: cells[c] for c in columns if c not in hints}) if infer else {}
    return df.withColumns(
        {
            c: hinted(cells[c], hints[c], c, F.col(row) if row else None, on_error)
            if c in hints
            else parsed(cells[c], inferred.get(c, "string"), sure=True)
            for c in columns
        }
    )
