"""Small helpers of the operators: free names, identities of rows, files in the shared folder."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.plans.staging import scratch_path


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be new (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``; names with dots or odd signs are taken as they are."""
    return F.col("`" + name.replace("`", "``") + "`").cast(kind).alias(name)


def identity(*columns: Column) -> Column:
    """128 bits of the columns as 32 hex digits: equal for equal values, for all intents only then."""
    one = F.xxhash64(*columns)
    two = F.xxhash64(F.lit(0x5BD1E995), *columns, F.lit("rowtide"))
    return F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0"))


def crc32_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


# --- files in the shared folder ------------------------------------------------------


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; files in it are made by tasks."""
    path = scratch_path(spark, label)
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def file_system(uri: str):
    """Arrow's file system for a URI, and the path within it."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else uri
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> tuple[str, object]:
    """URI and output stream of a file that no other attempt of any task writes to."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes: memory-mapped where the folder is mounted, else read."""
    system, path = file_system(uri)
    if type(system).__name__ == "LocalFileSystem":
        return np.memmap(path, dtype=np.uint8, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)
