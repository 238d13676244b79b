"""Lines of text files in splits, where line breaks are not one ASCII byte.

Spark's own text source splits files at the bytes of a line break. In UTF-16 or UTF-32
these bytes also occur across two characters, so a split has to look for a break at
places that are whole code units away from the begin of the file. This source does;
each task reads its range of bytes, to the end of the line that begins last in it.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowtide.sources.recordings import _filesystem

FORMAT = "rowtide_text_splits"
_CHUNK = 1 << 20
# fixed values: byte order marks, longer ones first
_MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF8, "utf-8"))
_LINES = "file string, block long, pos long, value string"
_ERRORS = "file string, at long"


@dataclass
class _Split(InputPartition):
    path: str
    size: int
    begin: int
    end: int


class BadByte(ValueError):
    """Bytes that are not of the encoding, by their place in the file."""

    def __init__(self, path: str, at: int, encoding: str):
        super().__init__(f"{path}: byte {at} is not {encoding.upper()} (encoding {encoding!r})")
        self.at = at


def line_break(encoding: str) -> bytes:
    """A line feed in the encoding, without a byte order mark."""
    return "\n\n".encode(encoding)[-(len("\n\n\n".encode(encoding)) - len("\n\n".encode(encoding))) :]


class SplitReader:
    """Lines of one range of bytes of a file.

    A line belongs to the range in which it begins: at 0, or right behind a line break.
    """

    def __init__(self, file, path: str, encoding: str, strict: bool, crs: bool):
        self.file, self.path, self.encoding, self.strict, self.crs = file, path, codecs.lookup(encoding).name, strict, crs
        self.skip, self.codec = 0, self.encoding
        head = file.read(4)
        for mark, codec in _MARKS:
            # an encoding that names its byte order takes a mark as a character, as Python does
            if head.startswith(mark) and self.encoding in (codec[:6], codec + "-sig"):
                self.skip, self.codec = len(mark), codec
        if self.encoding in ("utf-16", "utf-32") and not self.skip:
            self.codec += "-le"
        self.feed = line_break(self.codec)

    def lines(self, begin: int, end: int) -> Iterator[list[str]]:
        """Lists of successive lines."""
        unit = len(self.feed)
        at = self.skip if begin == 0 else self._after_break(max(begin - unit, 0))
        held = b""
        while at is not None and at < end:
            self.file.seek(at + len(held))
            chunk = self.file.read(max(_CHUNK, len(held)))
            held += chunk
            if chunk:
                cut = self._cut(held, max(end - at - unit, 0))
                if not cut:
                    continue
            else:
                cut = len(held)
            if not cut:
                return
            text = self._decoded(held[:cut], at)
            yield self._split(text)
            at, held = at + cut, held[cut:]

    def _cut(self, held: bytes, last: int) -> int:
        """Behind the first break at or after ``last``, else behind the last one held; 0 if there is none."""
        found = self._find(held, min(last, len(held)))
        if found < 0:
            found = len(held)
            while (found := held.rfind(self.feed, 0, found + len(self.feed) - 1)) > 0 and found % len(self.feed):
                pass
        return found + len(self.feed) if found >= 0 and found % len(self.feed) == 0 else 0

    def _find(self, held: bytes, start: int) -> int:
        unit = len(self.feed)
        found = held.find(self.feed, start + -start % unit)
        while found > 0 and found % unit:
            found = held.find(self.feed, found + 1)
        return found

    def _after_break(self, at: int) -> int | None:
        at += -at % len(self.feed)  # files begin with a whole unit, a mark is one
        while True:
            self.file.seek(at)
            held = self.file.read(_CHUNK)
            found = self._find(held, 0)
            if found >= 0:
                return at + found + len(self.feed)
            if not held:
                return None
            at += max(len(held) - len(held) % len(self.feed), 1)

    def _decoded(self, raw: bytes, at: int) -> str:
        try:
            return raw.decode(self.codec, "strict" if self.strict else "replace")
        except UnicodeDecodeError as error:
            raise BadByte(self.path, at + error.start, self.encoding) from None

    def _split(self, text: str) -> list[str]:
        lines = re.split("\r\n|\n|\r", text) if self.crs else text.split("\n")
        return lines[:-1] if text.endswith(("\n", "\r") if self.crs else "\n") else lines


class TextSplits(DataSource):
    """``spark.read.format("rowtide_text_splits")``; see ``aligned_lines``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _ERRORS if self.options.get("view") == "errors" else _LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.encoding = options["encoding"]
        self.strict = options["strict"] == "true"
        self.crs = options["crs"] == "true"
        self.errors = options.get("view") == "errors"
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 1 << 27)))

    def partitions(self) -> list[InputPartition]:
        step = self.split_bytes - self.split_bytes % 4 or 4
        splits = [_Split(p, size, a, min(a + step, size)) for p, size in self.files for a in range(0, size, step)]
        return splits or [_Split("", 0, 0, 0)]

    def read(self, split: _Split) -> Iterator:
        if not split.size:
            return
        system, inner = _filesystem(split.path)
        with system.open_input_file(inner) as file:
            lines = SplitReader(file, split.path, self.encoding, self.strict or self.errors, self.crs).lines(split.begin, split.end)
            if self.errors:
                try:
                    for _ in lines:
                        pass
                except BadByte as error:
                    yield (split.path, error.at)
                return
            pos = 0
            for some in lines:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([split.path] * len(some), pa.string()),
                        pa.array([split.begin] * len(some), pa.int64()),
                        pa.array(range(pos, pos + len(some)), pa.int64()),
                        pa.array(some, pa.string()),
                    ],
                    names=["file", "block", "pos", "value"],
                )
                pos += len(some)


def _load(spark: SparkSession, files: Sequence[tuple[str, int]], encoding: str, view: str, strict: bool, crs: bool) -> DataFrame:
    spark.dataSource.register(TextSplits)
    reader = spark.read.format(FORMAT).option("files", json.dumps(files)).option("encoding", encoding)
    reader = reader.option("view", view).option("strict", str(strict).lower()).option("crs", str(crs).lower())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole = sum(size for _, size in files)
    share = max(whole // spark.sparkContext.defaultParallelism, 1 << 22)  # as Spark's own sources cut files
    return reader.option("splitBytes", min(most, share)).load()


def aligned_lines(
    spark: SparkSession, files: Sequence[tuple[str, int]], encoding: str, strict: bool = True, carriage_returns: bool = True
) -> DataFrame:
    """``file``, ``block`` (begin of the split), ``pos`` (from 0 in it), ``value`` of all lines of the files, given with their sizes.

    Bytes that are not of the encoding raise, naming the place, or become U+FFFD. Lines
    end at line feeds, and with ``carriage_returns`` also at CR and CR LF.
    """
    return _load(spark, files, encoding, "lines", strict, carriage_returns)


def first_bad_byte(spark: SparkSession, files: Sequence[tuple[str, int]], encoding: str) -> tuple[str, int] | None:
    """The first file, in path order, with bytes that are not of the encoding, and the first one's place."""
    found = _load(spark, files, encoding, "errors", True, True)
    row = found.agg(F.min(F.struct("file", "at")).alias("first")).first()["first"]
    return None if row is None else (row["file"], row["at"])


def text_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Path and size of all files that aren't empty, in path order; their content isn't read."""
    found = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    return sorted((r["path"], r["length"]) for r in found.collect())
