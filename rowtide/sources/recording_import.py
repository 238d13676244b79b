"""Import of recordings into a table with signal and file catalogs.

An import audits the files and writes frames and catalog rows of exactly those that it
found valid, into folders of its own. It counts once the table's next manifest names
these folders, so a job that dies half-way leaves nothing visible, and a file that arrives
meanwhile is in no table. A replacing import's manifest names nothing else.

    <root>/<table>/import_id=.../<attempt>                      frames
    <root>/_signals/import_table=.../import_id=.../<attempt>    one row per file and signal
    <root>/_files/import_table=.../import_id=.../<attempt>      one row per file, bad ones included
    <root>/_manifests/<table>/<number>.json                     the imports that count
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions.names import check_table_name
from rowtide.plans.staging import release, stage
from rowtide.sources.manifests import add_manifest, folders, last_manifest
from rowtide.sources.recordings import (
    FILE_COLUMNS,
    SIGNAL_COLUMNS,
    audit_recordings,
    audited_frames,
    audited_signals,
    frame_schema,
)

FILES, SIGNALS, MANIFESTS = "_files", "_signals", "_manifests"
_IMPORT = "import_table string, import_id string"


@dataclass(frozen=True)
class ImportResult:
    import_id: str
    imported_files: int
    rejected_files: int
    frame_count: int


def import_recordings(
    spark: SparkSession,
    path,
    root: str,
    table: str,
    on_bad_file: str = "fail",
    mode: str = "replace",
    import_id: str | None = None,
) -> ImportResult:
    """Import all recordings at ``path`` into ``table`` below ``root``.

    ``on_bad_file="fail"`` imports nothing if any file is bad; ``"quarantine"`` lists bad
    files in the file catalog and imports the others. ``mode="append"`` adds to what is
    there; repeating an ``import_id`` takes that import's place and so adds nothing twice.
    """
    check_table_name(table)
    if on_bad_file not in ("fail", "quarantine"):
        raise ValueError(f"on_bad_file must be 'fail' or 'quarantine', not {on_bad_file!r}")
    if mode not in ("replace", "append"):
        raise ValueError(f"mode must be 'replace' or 'append', not {mode!r}")
    audit = stage(audit_recordings(spark, path), "recording-audit")
    counts = audit.agg(
        F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if(F.col("status") != "valid").alias("rejected"),
        F.coalesce(F.sum("imported_frame_count"), F.lit(0)).alias("frames"),
    ).first()
    if counts["rejected"] and on_bad_file == "fail":
        some = audit.where("status != 'valid'").select("file_path", "error").take(3)
        raise ValueError(f"{counts['rejected']} bad recordings, among them {[tuple(r) for r in some]}")

    import_id, attempt = import_id or uuid.uuid4().hex, uuid.uuid4().hex
    place = f"import_table={table}/import_id={import_id}/{attempt}"
    entry = {"import_id": import_id, "files": f"{FILES}/{place}", "signals": f"{SIGNALS}/{place}", "frames": None}
    valid = audit.where("status = 'valid'")
    signals = stage(audited_signals(valid), "recording-signals")
    if counts["valid"]:
        entry["frames"] = f"{table}/import_id={import_id}/{attempt}"
        audited_frames(valid, frame_schema(signals)).write.parquet(f"{root}/{entry['frames']}")
    signals.write.parquet(f"{root}/{entry['signals']}")
    now = datetime.datetime.now(datetime.timezone.utc)
    audit.withColumn("imported_at", F.lit(now)).write.parquet(f"{root}/{entry['files']}")
    release(audit, signals)

    def with_entry(entries: list[dict]) -> list[dict]:
        kept = [e for e in entries if e["import_id"] != import_id] if mode == "append" else []
        return [*kept, entry]

    add_manifest(spark, f"{root}/{MANIFESTS}/{table}", with_entry)
    return ImportResult(import_id, counts["valid"], counts["rejected"], counts["frames"])


def recording_files(spark: SparkSession, root: str, table: str | None = None) -> DataFrame:
    """The file catalog: files of the imports which count, for one table or all."""
    return _catalog(spark, root, table, "files", FILES, f"{FILE_COLUMNS}, imported_at timestamp, {_IMPORT}")


def recording_signals(spark: SparkSession, root: str, table: str | None = None) -> DataFrame:
    """The signal catalog of the imports which count."""
    return _catalog(spark, root, table, "signals", SIGNALS, f"{SIGNAL_COLUMNS}, {_IMPORT}")


def read_imported(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Frames of an imported table."""
    frames = [f"{root}/{e['frames']}" for e in _entries(spark, root, table) if e["frames"]]
    if not frames:
        raise ValueError(f"no recordings in table {table!r}")
    return spark.read.schema(frame_schema(recording_signals(spark, root, table))).parquet(*frames)


def _entries(spark: SparkSession, root: str, table: str | None) -> list[dict]:
    tables = folders(spark, f"{root}/{MANIFESTS}") if table is None else [check_table_name(table)]
    return [e for t in tables for e in last_manifest(spark, f"{root}/{MANIFESTS}/{t}")[1]]


def _catalog(spark: SparkSession, root: str, table: str | None, name: str, folder: str, schema: str) -> DataFrame:
    """Rows of a catalog; ids that look like numbers or dates stay the text they are."""
    paths = [f"{root}/{e[name]}" for e in _entries(spark, root, table)]
    if not paths:
        raise ValueError(f"nothing imported below {root}" + (f" in table {table!r}" if table else ""))
    return spark.read.schema(schema).option("basePath", f"{root}/{folder}").parquet(*paths)
