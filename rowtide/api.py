"""One object per file format, with a method per task on files.

Each method reads the file anew; to run several queries, read once and use the
functions of ``rowtide.operators`` on the DataFrame.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rowtide.operators import lookup, sampling
from rowtide.sources import sparse_csv
from rowtide.sources.sparse_csv import SparseFormat
from rowtide.streaming.sinks import write_sparse_stream

INDEX = "row_index"


@dataclass(frozen=True)
class SparseCsv:
    """Reads, queries, samples and writes sparse files of one format."""

    spark: SparkSession
    format: SparseFormat = field(default_factory=SparseFormat)
    type_hints: Mapping[str, object] = field(default_factory=dict)
    infer: bool = True
    chunk_size: int = 0

    def read_all(self, path) -> DataFrame:
        """Expanded, typed rows with their ``row_index``."""
        return sparse_csv.read_sparse_csv(
            self.spark, path, self.format, type_hints=self.type_hints, infer=self.infer, row_index=INDEX
        )

    def read_chunks(self, path, chunk_size: int | None = None) -> Iterator[list[Row]]:
        """Lists of rows on the driver, in order."""
        size = self.chunk_size if chunk_size is None else chunk_size
        return sparse_csv.iter_chunks(self.read_all(path), size)

    def iter_rows(self, path) -> Iterator[Row]:
        """Rows on the driver, in order."""
        return sparse_csv.iter_rows(self.read_all(path))

    def range_query(
        self, path, field: str, min_value: int | None = None, max_value: int | None = None
    ) -> DataFrame:
        return lookup.range_query(self.read_all(path), field, min_value, max_value)

    def row_query(
        self,
        path,
        row_numbers: Collection[int] | None = None,
        rowid_range: tuple[int, int] | None = None,
        rowid_set: Collection[int] | None = None,
    ) -> DataFrame:
        rows = self.read_all(path)
        return lookup.row_query(
            rows, row_numbers=row_numbers, rowid_range=rowid_range, rowid_set=rowid_set, row_index=INDEX
        )

    def sample(self, path, method: str, **options) -> DataFrame:
        """By method: ``bernoulli``, ``reservoir``, ``system``, ``cluster`` or ``lttb``;
        rows are told apart by their position."""
        if method in ("bernoulli", "reservoir", "lttb"):
            options.setdefault("key", INDEX)
        if method == "system":
            options.setdefault("row_index", INDEX)
        return sampling.sample(self.read_all(path), method, **options)

    def write_all(self, path: str, rows: DataFrame, order_by=INDEX, columns=None, **options) -> int:
        """Write rows in order; a ``row_index`` gives the order but is not written."""
        if columns is None:
            columns = [c for c in rows.columns if c != INDEX]
        return sparse_csv.write_sparse_csv(rows, path, order_by, self.format, columns, **options)

    def write_stream(
        self, path: str, stream: DataFrame, order_by, checkpoint: str, columns=None, **options
    ) -> StreamingQuery:
        return write_sparse_stream(stream, path, order_by, checkpoint, columns, format=self.format, **options)
