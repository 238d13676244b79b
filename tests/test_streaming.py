"""Streams give the same result as batches."""

import os
import random

from pyspark.sql import functions as F

from recording_bytes import SAMPLE_ROWS, SAMPLE_SIGNALS, recording
from rowtide.operators.sampling import bernoulli
from rowtide.operators.sparse import expand_sparse
from rowtide.sources.recording_import import read_imported, recording_files
from rowtide.sources.sparse_csv import read_sparse_csv
from rowtide.streaming import expand
from rowtide.streaming.expand import expand_stream
from rowtide.streaming.sinks import import_recording_stream, write_sparse_stream

SCHEMA = "id bigint, user bigint, a double, b string"


def feed(spark, tmp_path, rows, parts):
    """Files with rising modification times, one per batch."""
    folder = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for i in range(parts):
        df = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 10**9:
                os.utime(f"{folder}/{name}", (1000 * (i + 1), 1000 * (i + 1)))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def random_rows(n):
    rng = random.Random(4)
    return [
        (i, rng.choice([None, 1, 1, 2, 3]), rng.choice([None, None, 1.5, 2.5]), rng.choice(["", " ", "", "x", "y"]))
        for i in range(n)
    ]


def test_expand_stream_equals_batch(spark, tmp_path):
    rows = random_rows(200)
    for keys in ("user", ()):
        base = tmp_path / f"k{len(keys)}"
        stream = feed(spark, base, rows, 4)
        out = str(base / "out")
        expand_stream(stream, "id", ["a", "b"], out, str(base / "state"), str(base / "cp"), keys).awaitTermination()
        got = spark.read.parquet(out)
        assert got.select("batch_id").distinct().count() == 4
        want = expand_sparse(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], keys)
        assert got.drop("batch_id").orderBy("id").collect() == want.orderBy("id").collect()


def test_carried_rows_are_merged_and_batches_can_run_again(spark, tmp_path):
    rows = random_rows(130)
    want = expand_sparse(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], "user").orderBy("id").collect()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(13):
        batch = spark.createDataFrame(rows[10 * i : 10 * i + 10], SCHEMA)
        for _ in range(2 if i % 3 == 0 else 1):  # some batches die after their last write, and run again
            expand._expand_batch(batch, i, "id", ["a", "b"], ["user"], out, state, "whitespace")
        runs = sorted(os.listdir(state))
        assert len(runs) <= 2 * (i + 1).bit_length() + 1
        assert all(spark.read.parquet(f"{state}/{r}").count() <= 4 for r in runs)  # a row for each key at most
    assert expand._runs(spark, state, 13) == [(0, 8), (8, 12), (12, 13)]
    assert sorted(os.listdir(state)) == [f"batches-{a:012d}-{b:012d}" for a, b in ((0, 8), (8, 12), (12, 13))]
    assert spark.read.parquet(out).drop("batch_id").orderBy("id").collect() == want


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(5, 1, 1.0, "x"), (3, 1, 9.0, "late"), (6, 1, None, "")]
    out = str(tmp_path / "out")
    stream = feed(spark, tmp_path, rows, 3)
    expand_stream(stream, "id", ["a", "b"], out, str(tmp_path / "s"), str(tmp_path / "cp"), "user").awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).drop("batch_id").orderBy("id").collect()]
    assert got == [(5, 1, 1.0, "x"), (6, 1, 1.0, "x")]


def test_sparse_stream_sink(spark, tmp_path):
    rows = [(i, i // 50, float(i // 20), "t") for i in range(200)]
    out = str(tmp_path / "out")
    write_sparse_stream(feed(spark, tmp_path, rows, 3), out, "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted(d for d in os.listdir(out) if d.startswith("batch")) == [f"batch={i:010d}" for i in range(3)]
    back = read_sparse_csv(spark, out)
    assert [tuple(r)[1:] for r in back.orderBy("row_index").collect()] == rows


def test_streaming_bernoulli(spark, tmp_path):
    rows = random_rows(500)
    query = (
        bernoulli(feed(spark, tmp_path, rows, 2), 0.3, "id", 7)
        .writeStream.format("memory").queryName("sampled").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = bernoulli(spark.createDataFrame(rows, SCHEMA), 0.3, "id", 7)
    assert sorted(r["id"] for r in spark.table("sampled").collect()) == sorted(r["id"] for r in want.collect())


def test_recording_drop_folder(spark, tmp_path):
    folder, root = tmp_path / "drop", str(tmp_path / "lake")
    folder.mkdir()
    good = recording(SAMPLE_SIGNALS, SAMPLE_ROWS)

    def arrive():
        import_recording_stream(
            spark, str(folder), root, "sim", str(tmp_path / "cp"), files_per_batch=2
        ).awaitTermination()

    for i in range(3):
        (folder / f"{i}.bin").write_bytes(good)
    arrive()
    assert read_imported(spark, root, "sim").count() == 9
    (folder / "bad.bin").write_bytes(good[:-4])
    (folder / "3.bin").write_bytes(good)
    arrive()
    arrive()
    assert read_imported(spark, root, "sim").count() == 12
    status = recording_files(spark, root, "sim").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in status} == {"valid": 4, "rejected": 1}
