"""Write a DataFrame as recordings, one file per value of a column.

The frames of a file are sorted and encoded in pieces, ranges of the order which hold about
the same number of rows whatever the files' sizes; then a task copies the pieces of a file
one behind the other.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.plans.staging import qualified, release, remove, scratch_path, stage
from rowtide.sources.recordings import END_MARKER, SIGNAL_TYPES, VERSION, Signal, _filesystem

# Spark type -> type code of the signal
_CODES = {"bigint": 4, "int": 5, "smallint": 6, "tinyint": 7, "boolean": 8, "float": 10, "double": 11, "string": 12, "binary": 13}
_BUFFER = 1 << 20
_PIECE_ROWS = 500_000


def write_recordings(
    df: DataFrame,
    path: str,
    file_by: str,
    time: str,
    signals: Sequence[str],
    order_by: Sequence[str],
    kinds: Mapping[str, tuple[int, tuple[int, ...]]] | None = None,
) -> DataFrame:
    """Write signals as ``<path>/<file_by>.bin``; returns file paths and frames, written.

    Signal 0 is ``time``, a non-negative integer; NULL cells are absent from their
    frame. ``kinds`` gives a signal's type code and dimensions where they don't follow from
    its column; arrays and complex numbers (two numbers each) come from flat arrays. A
    file is put together by one task, to a temporary name first.
    """
    spark = df.sparkSession
    path, pieces = qualified(spark, path), qualified(spark, scratch_path(spark, "recording-pieces"))
    kinds = {time: (0, ()), **{s: (_CODES.get(df.schema[s].dataType.simpleString()), ()) for s in signals}} | dict(kinds or {})
    described = [Signal(i, *kinds[name], name, "") for i, name in enumerate([time, *signals])]
    codes = [s.code for s in described[1:]]
    head = struct.pack("<QQ", VERSION, 1 + len(signals))
    for s in described:
        raw = s.name.encode()
        head += struct.pack("<BI", s.code, len(s.dims)) + b"".join(struct.pack("<I", d) for d in s.dims)
        head += struct.pack("<Q", len(raw)) + raw + struct.pack("<I", 0)
    width = (1 + len(signals) + 7) // 8

    def frames(pdf: pd.DataFrame) -> list[bytes]:
        """Bitmap, time and the values present, row by row from encoded columns."""
        bits = np.zeros((len(pdf), 8 * width), np.uint8)
        bits[:, 0] = 1
        parts = [[struct.pack("<Q", int(v)) for v in pdf[time]]]
        for i, (name, code) in enumerate(zip(signals, codes), start=1):
            present = pdf[name].notna().to_numpy()
            bits[:, i] = present
            kind = SIGNAL_TYPES[code][0]
            if kind is None:
                raws = [v.encode() if code == 12 and p else v for v, p in zip(pdf[name], present)]
                cells = [struct.pack("<Q", len(r)) + r if p else b"" for r, p in zip(raws, present)]
            else:
                if described[i].parts > 1:
                    none = np.zeros(described[i].parts)
                    values = np.stack([v if p else none for v, p in zip(pdf[name], present)]).astype(kind)
                else:
                    values = pdf[name].where(present, 0).to_numpy().astype(kind)
                size, data = described[i].size, values.tobytes()
                cells = [data[k * size : (k + 1) * size] if p else b"" for k, p in enumerate(present)]
            parts.append(cells)
        bitmaps = np.packbits(bits, axis=1, bitorder="little")
        return [b"".join([m.tobytes(), *cells]) for m, *cells in zip(bitmaps, *parts)]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One piece for each file that rows of the task belong to."""
        nth = TaskContext.get().partitionId()
        current, out, count, inner = None, None, 0, ""
        done = []

        def close():
            out.close()
            done.append((current, nth, inner, count))

        for pdf in batches:
            for name, rows in pdf.groupby("__file", sort=True):
                if name != current:
                    if out is not None:
                        close()
                    inner = f"{pieces}/{uuid.uuid4().hex}.piece"
                    fs, at = _filesystem(inner)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    current, out, count = name, fs.open_output_stream(at, buffer_size=_BUFFER), 0
                out.write(b"".join(frames(rows)))
                count += len(rows)
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "nth", "piece", "frames"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copy the pieces of each file, which come in order, behind its header."""
        current, out, count = None, None, 0
        done = []

        def close():
            out.write(struct.pack("<Q", END_MARKER))
            out.close()
            fs, inner = _filesystem(f"{path}/{current}")
            fs.move(inner + ".part", inner + ".bin")
            done.append((f"{path}/{current}.bin", count))

        for pdf in batches:
            for name, piece, n in zip(pdf["file"], pdf["piece"], pdf["frames"]):
                if name != current:
                    if out is not None:
                        close()
                    fs, inner = _filesystem(f"{path}/{name}")
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    current, out, count = name, fs.open_output_stream(inner + ".part", buffer_size=_BUFFER), 0
                    out.write(head)
                fs, at = _filesystem(piece)
                with fs.open_input_stream(at) as source:
                    while some := source.read(_BUFFER):
                        out.write(some)
                count += n
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["file_path", "frames"])

    rows = df.select(F.col(file_by).cast("string").alias("__file"), time, *signals, *[c for c in order_by if c not in (time, *signals)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, df.count() // _PIECE_ROWS)
    rows = rows.repartitionByRange(ranges, "__file", *order_by).sortWithinPartitions("__file", *order_by)
    written = stage(rows.mapInPandas(write, "file string, nth int, piece string, frames long"), "recording-pieces")
    ordered = written.repartition(parts, "file").sortWithinPartitions("file", "nth")
    schema = T.StructType().add("file_path", T.StringType()).add("frames", T.LongType())
    files = stage(ordered.mapInPandas(join, schema), "recording-files")
    release(written)
    remove(spark, pieces)
    return files


def write_bytes(path: str, raw: bytes) -> None:
    """A file of these bytes."""
    fs, inner = _filesystem(path)
    with fs.open_output_stream(inner) as out:
        out.write(raw)
