"""Column names safe in any SQL dialect."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame


def normalize_names(names: Sequence[str]) -> list[str]:
    """Lower-case names of ``a-z0-9_``, unique.

    Other characters become one underscore, outer underscores go. A name that ends
    up empty or starts with a digit becomes ``signal_<position>``; repeats get
    ``_1``, ``_2`` and so on.
    """
    taken: set[str] = set()
    result = []
    for position, name in enumerate(names):
        # runs of foreign characters and underscores shrink together
        plain = re.sub(r"[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_")
        if not re.match(r"[a-z]", plain):
            plain = f"signal_{position}"
        unique, n = plain, 0
        while unique in taken:
            n += 1
            unique = f"{plain}_{n}"
        taken.add(unique)
        result.append(unique)
    return result


def normalize_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed by :func:`normalize_names`."""
    return df.toDF(*normalize_names(df.columns))


def check_table_name(name: str) -> str:
    """The name itself, if it is a plain identifier and no catalog's name."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""):
        raise ValueError(f"not a plain table name: {name!r}")
    if name.lower() in ("_files", "_signals"):
        raise ValueError(f"reserved for the catalogs of imports: {name!r}")
    return name
