"""Text form of values, as written to a sparse file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import types as T

_COMPOUND = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def to_text(cell: Column, data_type: T.DataType) -> Column:
    """The cell as text; booleans as true/false, NULL stays NULL."""
    if isinstance(data_type, _COMPOUND):
        raise TypeError(f"{data_type.simpleString()} has no text form in a sparse file")
    return cell if isinstance(data_type, T.StringType) else cell.cast("string")
