"""Streaming sinks and the recording drop folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rowtide.sources.recording_import import import_recordings
from rowtide.sources.sparse_csv import write_sparse_csv


def write_sparse_stream(
    stream: DataFrame,
    path: str,
    order_by: Sequence[str] | str | None,
    checkpoint: str,
    columns: Sequence[str] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Write each batch of a stream as sparse files in a folder of its own.

    The first row of a batch is full, so folders can be read alone or, as
    ``read_sparse_csv(path)``, together in batch order. A batch run again replaces
    its folder. Columns come from the stream's schema unless given.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write_sparse_csv(batch, f"{path}/batch={batch_id:010d}", order_by, columns=columns, **options)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def import_recording_stream(
    spark: SparkSession,
    folder: str,
    root: str,
    table: str,
    checkpoint: str,
    files_per_batch: int = 1_000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Import recordings as they arrive in a folder, each file once.

    Bad files are listed in the file catalog as rejected. Only paths go through the
    stream; the files are read by the recording source. Empty files never show up, as
    Spark's file listing leaves them out.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.bin")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most files_per_batch
        if paths:
            import_recordings(
                batch.sparkSession, paths, root, table, "quarantine", "append", f"batch-{batch_id:010d}"
            )

    return (
        arrivals.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
