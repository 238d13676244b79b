"""Which cells mean "same value as the row above"."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Inherit = str | Callable[[Column], Column]

# what Python's str.strip() removes; all such characters are below U+3001
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def inherits(cell: Column, mode: Inherit = "whitespace") -> Column:
    """True where a text cell takes the value above. NULL always does.

    ``mode``: ``"whitespace"`` (empty or blank cell), ``"empty"`` (empty cell only),
    or a function from the cell to a boolean column.
    """
    if callable(mode):
        return cell.isNull() | F.coalesce(mode(cell), F.lit(False))
    if mode == "whitespace":
        # only cells starting below "!" or outside ASCII can be blank: most are not trimmed
        may_be_blank = (cell < "!") | (cell >= "\x80")
        return cell.isNull() | (may_be_blank & (F.btrim(cell, F.lit(WHITESPACE)) == ""))
    if mode == "empty":
        return cell.isNull() | (cell == "")
    raise ValueError(f"unknown inherit mode {mode!r}: use 'whitespace', 'empty' or a function")


def equal_to(marker: str) -> Callable[[Column], Column]:
    """Mode for a marker of one's own, such as ``"-"``."""
    return lambda cell: cell == marker
