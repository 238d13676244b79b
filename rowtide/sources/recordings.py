"""Binary signal recordings as a Spark data source, with signal and file catalogs.

A recording is a header naming its signals, then time frames with a presence bitmap,
then an 8-byte end marker. Frames carry no length, so one file is read from front to
back by one task; many files run in parallel, small ones packed together. Within a
file, frames of the same presence pattern are decoded as whole numpy columns.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from rowtide.functions.names import normalize_names
from rowtide.plans.staging import qualified

FORMAT = "rowtide_recordings"

# fixed values: the file format
VERSION = 1
END_MARKER = 0xDEADBEEFDEADBEEF
MAX_SIGNALS = 1024
MAX_DIMENSIONS = 8
MAX_TEXT_BYTES = 1 << 20
MAX_BLOB_BYTES = 64 << 20
MAX_ELEMENTS = (1 << 31) - 1
# fixed values: type code -> (bytes in a frame as numpy type, Spark type)
SIGNAL_TYPES = {
    0: ("<u8", "decimal(20,0)"),
    1: ("<u4", "bigint"),
    2: ("<u2", "int"),
    3: ("u1", "smallint"),
    4: ("<i8", "bigint"),
    5: ("<i4", "int"),
    6: ("<i2", "smallint"),
    7: ("i1", "tinyint"),
    8: ("u1", "boolean"),
    9: ("<i8", "bigint"),
    10: ("<f4", "float"),
    11: ("<f8", "double"),
    12: (None, "string"),
    13: (None, "binary"),
    14: ("<f4", "struct<re:double,im:double>"),
    15: ("<f8", "struct<re:double,im:double>"),
}
STRING, BINARY, BOOL, COMPLEX = 12, 13, 8, (14, 15)

SIGNAL_COLUMNS = (
    "file_path string, signal_index bigint, original_name string, column_name string, "
    "signal_type smallint, dimension_count bigint, dimensions_json string, formula string, spark_type string"
)
FILE_COLUMNS = (
    "file_path string, format_version decimal(20,0), signal_count bigint, imported_frame_count bigint, "
    "eof_valid boolean, file_size_bytes bigint, status string, error string"
)

_READ_BYTES = 4 << 20
_BATCH_FRAMES = 20_000
_PACK_BYTES = 64 << 20
_PACK_LEAST = 1 << 18


class RecordingError(ValueError):
    """The file does not follow the format."""


class _NeedMore(Exception):
    """The frame goes on beyond the bytes read so far."""


@dataclass(frozen=True)
class Signal:
    index: int
    code: int
    dims: tuple[int, ...]
    name: str
    formula: str

    @cached_property
    def elements(self) -> int:
        return int(np.prod(self.dims, dtype=object)) if self.dims else 1

    @cached_property
    def parts(self) -> int:
        """Numbers of the frame type which make up one value."""
        return self.elements * (2 if self.code in COMPLEX else 1)

    @cached_property
    def size(self) -> int | None:
        """Bytes of one value, None where it varies."""
        kind = SIGNAL_TYPES[self.code][0]
        return None if kind is None else self.parts * np.dtype(kind).itemsize

    def spark_type(self, complex_: str) -> str:
        scalar = SIGNAL_TYPES[self.code][1]
        if self.code in COMPLEX and complex_ == "array":
            scalar = "array<double>"
        return f"array<{scalar}>" if self.dims else scalar


@dataclass(frozen=True)
class Header:
    signals: tuple[Signal, ...]

    @cached_property
    def columns(self) -> list[str]:
        return normalize_names([s.name for s in self.signals])


class _File:
    """Sequential access with the rest of the file known."""

    def __init__(self, path: str, size: int):
        fs, inner = _filesystem(path)
        self.stream = fs.open_input_stream(inner)
        self.size, self.at = size, 0

    def take(self, n: int, what: str) -> bytes:
        if n > self.size - self.at:
            raise RecordingError(f"file ended while reading {what}")
        data = self.stream.read(n)
        if len(data) < n:
            raise RecordingError(f"file ended while reading {what}")
        self.at += n
        return data

    def number(self, form: str, what: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form), what))[0]

    def text(self, length: int, what: str) -> str:
        if length > MAX_TEXT_BYTES:
            raise RecordingError(f"{what} is too long: {length}")
        return self.take(length, what).decode("utf-8", "replace")


def read_header(file: _File) -> Header:
    """Signals of a recording; raises :class:`RecordingError` where a rule is broken."""
    version = file.number("Q", "header")
    if version != VERSION:
        raise RecordingError(f"unsupported version {version}")
    count = file.number("Q", "header")
    if not 1 <= count <= MAX_SIGNALS:
        raise RecordingError(f"invalid signal count {count}")
    signals = []
    for index in range(count):
        what = f"signal {index}"
        code, n_dims = file.number("B", what), file.number("I", what)
        if code not in SIGNAL_TYPES:
            raise RecordingError(f"{what}: unknown type code {code}")
        if n_dims > MAX_DIMENSIONS:
            raise RecordingError(f"{what}: too many dimensions: {n_dims}")
        dims = tuple(file.number("I", what) for _ in range(n_dims))
        name = file.text(file.number("Q", what), f"{what} name")
        formula = file.text(file.number("I", what), f"{what} formula")
        signal = Signal(index, code, dims, name, formula)
        if any(d == 0 for d in dims) or signal.elements > MAX_ELEMENTS:
            raise RecordingError(f"{what}: invalid dimensions {list(dims)}")
        if not name.strip():
            raise RecordingError(f"{what}: blank name")
        if dims and signal.size is None:
            raise RecordingError(f"{what}: arrays of variable length are not allowed")
        signals.append(signal)
    if signals[0].code != 0 or signals[0].dims:
        raise RecordingError("signal 0 must be a scalar unsigned 64-bit time")
    return Header(tuple(signals))


class _Layout:
    """Where values lie in frames of one presence pattern.

    A value's place is a distance from the frame's start or, after values of varying
    length, from the end of the last such value before it.
    """

    def __init__(self, header: Header, bitmap: bytes):
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        if not bits[0]:
            raise RecordingError("frame without a time (bit 0 unset)")
        self.places: dict[int, tuple[int, int]] = {}  # signal -> (anchor, distance)
        self.varying: list[tuple[int, int]] = []  # (distance from anchor, longest allowed)
        distance = len(bitmap)
        for signal in header.signals:
            if not bits[signal.index]:
                continue
            self.places[signal.index] = (len(self.varying), distance)
            if signal.size is None:
                limit = MAX_TEXT_BYTES if signal.code == STRING else MAX_BLOB_BYTES
                self.varying.append((distance, limit))
                distance = 0
            else:
                distance += signal.size
        self.tail = distance

    def anchors(self, data: bytes, start: int) -> list[int]:
        """Start of a frame, ends of its varying values, and its end."""
        result = [start]
        for distance, limit in self.varying:
            at = result[-1] + distance
            if at + 8 > len(data):
                raise _NeedMore
            (length,) = struct.unpack_from("<Q", data, at)
            if length > limit:
                raise RecordingError(f"value too long: {length}")
            result.append(at + 8 + length)
        result.append(result[-1] + self.tail)
        if result[-1] > len(data):
            raise _NeedMore
        return result


def walk_frames(file: _File, header: Header) -> Iterator[tuple[bytes, list[tuple[_Layout, np.ndarray]]]]:
    """Pieces of the file with the anchors of all whole frames in them.

    Raises at the first broken frame and where the end marker is missing.
    """
    width = (len(header.signals) + 7) // 8
    layouts: dict[bytes, _Layout] = {}
    data, at = b"", 0
    body = file.size - 8  # frames end here, the marker follows
    while True:
        runs, frames = [], 0
        needed = 0  # bytes of the next frame, as far as known, where it is not whole
        while frames < _BATCH_FRAMES:
            bitmap = data[at : at + width]
            if len(bitmap) < width:
                needed = width
                break
            layout = layouts.get(bitmap) or layouts.setdefault(bitmap, _Layout(header, bitmap))
            if layout.varying:
                try:
                    anchors = np.array([layout.anchors(data, at)])
                except _NeedMore:
                    needed = width
                    break
            else:
                n = min((len(data) - at) // layout.tail, _BATCH_FRAMES - frames)
                if n == 0:
                    needed = layout.tail
                    break
                heads = np.ndarray((n, width), np.uint8, data, at, (layout.tail, 1))
                other = (heads != np.frombuffer(bitmap, np.uint8)).any(axis=1)
                n = int(other.argmax()) if other.any() else n
                start = at + layout.tail * np.arange(n)
                anchors = np.stack([start, start + layout.tail], axis=1)
            runs.append((layout, anchors))
            frames += len(anchors)
            at = int(anchors[-1, -1])
        if runs:
            yield data, runs
        if needed:  # all whole frames are out: only the beginning of one is copied
            rest, left = len(data) - at, max(0, body - file.at)
            if not rest and not left:
                break
            if not left or needed > rest + left:
                raise RecordingError("file ended while reading a frame")
            data, at = data[at:] + file.take(min(max(_READ_BYTES, rest), left), "frames"), 0
    if file.size - file.at != 8 or file.number("Q", "end marker") != END_MARKER:
        raise RecordingError("end marker is missing or cut off")


@dataclass(frozen=True)
class Pieces:
    """Stretches of some bytes, one for each row."""

    raw: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def joined(self) -> np.ndarray:
        """All stretches, one behind the other."""
        whole = int(self.length.sum())
        if whole > 32 * len(self.length):  # few long ones
            data = self.raw.data
            parts = [data[a : a + n] for a, n in zip(self.start.tolist(), self.length.tolist()) if n]
            return np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(self.length)
        return self.raw[np.arange(whole) + np.repeat(self.start - ends + self.length, self.length)]


def decode(header: Header, data: bytes, runs: list[tuple[_Layout, np.ndarray]]) -> dict[int, tuple]:
    """Per signal: presence mask and the values, as numpy array or pieces of the data."""
    total = sum(len(a) for _, a in runs)
    raw = np.frombuffer(data, np.uint8)
    # runs of one pattern may alternate frame by frame: decode each pattern at once
    patterns: dict[int, tuple[_Layout, list, list]] = {}
    first = 0
    for layout, anchors in runs:
        _, parts, at = patterns.setdefault(id(layout), (layout, [], []))
        parts.append(anchors)
        at.append(np.arange(first, first + len(anchors)))
        first += len(anchors)
    result = {}
    for signal in header.signals:
        present = np.zeros(total, bool)
        kind = SIGNAL_TYPES[signal.code][0]
        shape = (total, signal.parts)
        starts, lengths = np.zeros(total, np.int64), np.zeros(total, np.int64)
        values = Pieces(raw, starts, lengths) if kind is None else np.zeros(shape, kind)
        for layout, parts, at in patterns.values():
            if signal.index not in layout.places:
                continue
            anchor, distance = layout.places[signal.index]
            anchors, rows = np.concatenate(parts), np.concatenate(at)
            start = anchors[:, anchor] + distance
            present[rows] = True
            if kind is None:
                starts[rows] = start + 8
                lengths[rows] = anchors[:, anchor + 1] - start - 8
            else:
                cells = raw[start[:, None] + np.arange(signal.size)]
                values[rows] = np.ascontiguousarray(cells).view(kind)
        result[signal.index] = (present, values)
    return result


def to_arrow(signal: Signal, present: np.ndarray, values: np.ndarray, type_: pa.DataType) -> pa.Array:
    """The values as an Arrow column, NULL where not present."""
    absent = ~present
    if signal.code in (STRING, BINARY):
        return _varying(signal, present, values, type_)
    if signal.code == BOOL:
        values = values != 0
    scalar = type_.value_type if signal.dims else type_
    flat = values.reshape(-1)
    if signal.code in COMPLEX:
        flat = flat.astype(np.float64)
        if pa.types.is_struct(scalar):
            items = pa.StructArray.from_arrays([flat[0::2], flat[1::2]], fields=list(scalar))
        else:
            items = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 2, np.int32), pa.array(flat)).cast(scalar)
    else:
        items = pa.array(flat).cast(scalar)
    if signal.dims:
        ends = np.arange(0, len(items) + 1, signal.elements, np.int32)
        return pa.ListArray.from_arrays(ends, items, mask=pa.array(absent)).cast(type_)
    if not absent.any():
        return items
    return items.take(pa.array(np.arange(len(present)), mask=absent))


def _varying(signal: Signal, present: np.ndarray, values: Pieces, type_: pa.DataType) -> pa.Array:
    """Texts or bytes as one buffer and offsets; texts that aren't UTF-8 get replacement characters."""
    data = values.joined()
    offsets = np.concatenate([[0], np.cumsum(values.length)])
    if signal.code == STRING and not _all_utf8(data, offsets):
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") if p else None for a, b, p in zip(offsets[:-1], offsets[1:], present)]
        return pa.array(texts, type_)
    valid = np.packbits(present, bitorder="little")
    buffers = [pa.py_buffer(valid), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    large = pa.large_string() if signal.code == STRING else pa.large_binary()
    return pa.Array.from_buffers(large, len(present), buffers).cast(type_)


def _all_utf8(data: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether each piece by itself is UTF-8: all together are, and none begins within a character."""
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return False
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    return not ((data[begins] & 0xC0) == 0x80).any()


def list_recordings(path: str, suffix: str = ".bin") -> list[tuple[str, int]]:
    """(path, size) of a recording, or of all below a folder, in path order."""
    fs, inner = _filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and (info.is_file or f.path.endswith(suffix)))


def _ends(path: str, size: int) -> tuple[Decimal | None, bool]:
    """The version a file names, whatever follows, and whether it ends with the marker."""
    if size < 8:
        return None, False
    fs, inner = _filesystem(path)
    with fs.open_input_file(inner) as file:
        first = file.read(8)
        file.seek(size - 8)
        last = file.read(8)
    return Decimal(struct.unpack("<Q", first)[0]), struct.unpack("<Q", last)[0] == END_MARKER


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class _Pack(InputPartition):
    """Files one task reads."""

    files: list[tuple[str, int]]


def _packs(files: list[tuple[str, int]], target: int) -> list[_Pack]:
    """Large files alone and first, small ones together up to the target size."""
    packs: list[_Pack] = []
    filled = target
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if filled + size > target or size >= target:
            packs.append(_Pack([]))
            filled = 0
        packs[-1].files.append((path, size))
        filled += max(size, 1 << 16)  # opening a file has its price
    return packs


class RecordingSource(DataSource):
    """``spark.read.format("rowtide_recordings")``.

    Options: ``path``; ``view`` is ``frames`` (needs a schema), ``signals`` or
    ``files``; ``on_bad_file`` is ``fail`` or ``skip``; ``complex`` is ``struct`` or
    ``array``; ``suffix`` of files in folders; ``packBytes`` per task at most, less if
    the files would not give work to ``tasks`` tasks.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        view = self.options.get("view", "frames")
        if view == "signals":
            return SIGNAL_COLUMNS
        if view == "files":
            return FILE_COLUMNS
        raise ValueError("frames need a schema: use read_recordings")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _RecordingReader(schema, dict(self.options))


class _RecordingReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.path = options["path"]
        self.paths = json.loads(options["recordings"]) if "recordings" in options else [self.path]
        self.view = options.get("view", "frames")
        self.skip_bad = options.get("on_bad_file", options.get("onBadFile", "fail")) == "skip"
        self.complex = options.get("complex", "struct")
        self.suffix = options.get("suffix", ".bin")
        self.pack_bytes = int(options.get("packbytes", options.get("packBytes", _PACK_BYTES)))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[InputPartition]:
        files = [f for p in self.paths for f in list_recordings(p, self.suffix)]
        share = sum(size for _, size in files) // self.tasks
        return _packs(files, min(self.pack_bytes, max(share, _PACK_LEAST))) or [_Pack([])]

    def read(self, partition: _Pack) -> Iterator:
        for path, size in partition.files:
            if self.view == "files":
                yield self._audit(path, size)
                continue
            try:
                if self.view == "signals":
                    yield from self._signals(path, size)
                else:
                    if self.skip_bad:  # no row of a bad file may come out
                        file = _File(path, size)
                        for _ in walk_frames(file, read_header(file)):
                            pass
                    yield from self._frames(path, size)
            except RecordingError as error:
                if not self.skip_bad:
                    raise RecordingError(f"{path}: {error}") from None

    def _audit(self, path: str, size: int) -> tuple:
        file, header, frames, error = _File(path, size), None, 0, None
        try:
            header = read_header(file)
            for _, runs in walk_frames(file, header):
                frames += sum(len(a) for _, a in runs)
        except RecordingError as e:
            error = str(e)
        version, marked = _ends(path, size)
        return (
            path,
            version,
            len(header.signals) if header else None,
            0 if error else frames,
            marked,
            size,
            "rejected" if error else "valid",
            error,
        )

    def _signals(self, path: str, size: int) -> Iterator[tuple]:
        header = read_header(_File(path, size))
        for signal, column in zip(header.signals, header.columns):
            yield (
                path,
                signal.index,
                signal.name,
                column,
                signal.code,
                len(signal.dims),
                str(list(signal.dims)),
                signal.formula,
                signal.spark_type(self.complex),
            )

    def _frames(self, path: str, size: int) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        file = _File(path, size)
        header = read_header(file)
        by_column = dict(zip(header.columns, header.signals))
        first = 0
        for data, runs in walk_frames(file, header):
            decoded = decode(header, data, runs)
            rows = sum(len(a) for _, a in runs)
            arrays = []
            for field in schema:
                if field.name == "file_path":
                    arrays.append(pa.array([path] * rows, field.type))
                elif field.name == "frame_index":
                    arrays.append(pa.array(np.arange(first, first + rows), field.type))
                elif field.name in by_column:
                    signal = by_column[field.name]
                    arrays.append(to_arrow(signal, *decoded[signal.index], field.type))
                else:
                    arrays.append(pa.nulls(rows, field.type))
            first += rows
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _view(spark: SparkSession, path, view: str, schema: T.StructType | None = None, **options) -> DataFrame:
    spark.dataSource.register(RecordingSource)
    paths = [qualified(spark, p) for p in ([path] if isinstance(path, str) else path)]
    reader = spark.read.format(FORMAT).option("view", view).option("recordings", json.dumps(paths))
    reader = reader.option("tasks", spark.sparkContext.defaultParallelism)
    for name, value in options.items():
        reader = reader.option(name, value)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths[0])


def read_recording_signals(spark: SparkSession, path, on_bad_file: str = "fail", complex: str = "struct") -> DataFrame:
    """One row per file and signal; reads only the headers."""
    return _view(spark, path, "signals", on_bad_file=_policy(on_bad_file), complex=complex)


def audit_recordings(spark: SparkSession, path) -> DataFrame:
    """One row per file: version, counts, size, and whether it is whole or why not."""
    return _view(spark, path, "files")


def read_recordings(spark: SparkSession, path, on_bad_file: str = "fail", complex: str = "struct") -> DataFrame:
    """All frames below a path, with ``file_path`` and ``frame_index``.

    Files with different signals are united by column name, absent columns NULL; a
    column with two types raises. Signal metadata is on the columns. A bad file fails
    the job, or with ``on_bad_file="skip"`` contributes no row.
    """
    if complex not in ("struct", "array"):
        raise ValueError(f"complex must be 'struct' or 'array', not {complex!r}")
    signals = read_recording_signals(spark, path, on_bad_file, complex)
    schema = frame_schema(signals)
    return _view(spark, path, "frames", schema, on_bad_file=on_bad_file, complex=complex)


def audited_signals(files: DataFrame, complex: str = "struct") -> DataFrame:
    """:func:`read_recording_signals` of exactly these rows of an audit."""
    names = [f.name for f in T.StructType.fromDDL(SIGNAL_COLUMNS)]
    reader = _RecordingReader(None, {"path": "", "view": "signals", "complex": complex})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, size in zip(rows["file_path"], rows["file_size_bytes"]):
                yield pd.DataFrame(list(reader._signals(path, int(size))), columns=names)

    return _dealt(files).mapInPandas(read, SIGNAL_COLUMNS)


def audited_frames(files: DataFrame, schema: T.StructType, complex: str = "struct") -> DataFrame:
    """:func:`read_recordings` of exactly these rows of an audit, as long as they were then."""
    reader = _RecordingReader(schema, {"path": "", "complex": complex})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                yield from reader._frames(row["file_path"], row["file_size_bytes"])

    return _dealt(files).mapInArrow(read, schema)


def _dealt(files: DataFrame) -> DataFrame:
    """Paths and sizes over as many tasks as the bytes are worth."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("file_size_bytes"), F.lit(0))).first()
    tasks = max(size // _PACK_BYTES, min(files.sparkSession.sparkContext.defaultParallelism, size // _PACK_LEAST), 1)
    return files.select("file_path", "file_size_bytes").repartition(int(min(tasks, max(n, 1))))


def frame_schema(signals: DataFrame) -> T.StructType:
    """Schema of the frames of the files in a signal catalog."""
    about = ["original_name", "signal_type", "dimensions_json", "formula"]
    found = (
        signals.groupBy("column_name")
        .agg(
            F.min("signal_index").alias("at"),
            F.sort_array(F.collect_set("spark_type")).alias("types"),
            *[F.min(c).alias(c) for c in about],
        )
        .orderBy("at", "column_name")
        .collect()
    )
    if clash := {r["column_name"]: r["types"] for r in found if len(r["types"]) > 1}:
        raise ValueError(f"columns with several types: {clash}")
    if taken := {"file_path", "frame_index"} & {r["column_name"] for r in found}:
        raise ValueError(f"signals must not be named {sorted(taken)}")
    schema = T.StructType().add("file_path", T.StringType()).add("frame_index", T.LongType())
    for r in found:
        schema = schema.add(r["column_name"], T.DataType.fromDDL(r["types"][0]), True, {c: r[c] for c in about})
    return schema


def _policy(on_bad_file: str) -> str:
    if on_bad_file not in ("fail", "skip"):
        raise ValueError(f"on_bad_file must be 'fail' or 'skip', not {on_bad_file!r}")
    return on_bad_file


def frame_time(column: str = "time_ns") -> F.Column:
    """Timestamp of a nanosecond count since 1970; the last three digits are lost."""
    return F.timestamp_micros(F.expr(f"cast(`{column}` as decimal(20,0)) div 1000"))
